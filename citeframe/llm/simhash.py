"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has 64 bits; two texts are linked when at most three differ. The 64 bits are seen as a ring
of 16 segments of four bits. If at most 3 bits differ in all, some segment starts a chain whose first ``l``
segments differ in at most ``floor(3 l / 16)`` bits for every ``l`` (pigeonring principle): none in the first
five segments, at most one in ten, two in fifteen. From each start the first five segments must therefore
agree exactly, and of the next 20 bits one half of ten must agree too. Those 30 bits are the key of a bucket;
inside a bucket the chain budgets are tested before the full Hamming distance.

Only distinct fingerprints are bucketed, so copies never meet as pairs. A bucket above ``BUCKET`` members is
divided again by the bits that vary in it: at most three of them differ, so one of four blocks agrees. That goes on
until every bucket is small, which ends because members of a bucket are distinct. Inside a bucket each local
component gives one edge per member to its smallest member, never all pairs; no link is lost.

Spark sizes exploded keys and staged files far too low, and so would broadcast tables that the driver cannot hold; a
plan once made so stays so, as the other one has more shuffles. Joins of as many rows as texts or keys are sort-merge.

Defined cases: a null or wordless text has fingerprint 0 and is linked like any other. A null ``doc_id`` never
becomes a component id unless the whole component has none. Repeated rows share a fingerprint and stay rows of
their own. An empty table gives an empty result. Extra columns are kept apart in a struct, whatever their names.
"""

from __future__ import annotations

import sys
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from citeframe.llm.components import connected
from citeframe.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENT = 4
BUCKET = 4096
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Fingerprint of one text: bit set if set in over half of the shingle hashes, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        n = len(words) - SHINGLE + 1
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles)
    ones, left = np.zeros(64, np.int64), n
    while left:
        size = min(left, _CHUNK)
        block = np.fromiter(islice(hashes, size), np.uint64, size)
        ones += np.unpackbits(block.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        left -= size
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def simhash(texts: pa.Array) -> pa.Array:
    out = np.fromiter(map(fingerprint, texts.to_pylist()), np.uint64, len(texts))
    return pa.array(out.view(np.int64), pa.int64())


def chain_keys(fp: str = "fp"):
    """The 32 bucket keys of a fingerprint: start and half above 30 bits."""
    keys = []
    for start in range(0, 64, SEGMENT):
        ring = F.col(fp)
        if start:
            ring = F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, 64 - start))
        head = F.shiftrightunsigned(ring, 44)
        for half, shift in enumerate((34, 24)):
            tail = F.shiftrightunsigned(ring, shift).bitwiseAND(F.lit(1023))
            tag = (start // SEGMENT * 2 + half) << 30
            keys.append(F.shiftleft(head, 10).bitwiseOR(tail).bitwiseOR(F.lit(tag)))
    return F.array(*keys)


@lru_cache(maxsize=4096)
def _blocks(varying: int) -> tuple[int, ...]:
    """The bits that vary in a bucket, dealt into four blocks of neighbours."""
    bits = [b for b in range(64) if varying >> b & 1]
    cuts = [len(bits) * j // 4 for j in range(5)]
    return tuple(sum(1 << b for b in bits[cuts[j] : cuts[j + 1]]) for j in range(4))


def _divide(batches):
    """Four rows for each member of a large bucket, one for each block of the bits that vary in it."""
    names = ["tag", "mask", "fixed", "fp"]
    for batch in batches:
        tag = batch.column("tag").to_numpy()
        mask, varying, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("mask", "varying", "fp"))
        kinds, which = np.unique(varying, return_inverse=True)
        blocks = np.array([_blocks(int(v)) for v in kinds], np.uint64)[which] if len(fp) else np.zeros((0, 4), np.uint64)
        for j in range(4):
            wider = mask | blocks[:, j]
            columns = [tag, *(c.view(np.int64) for c in (wider, fp & wider, fp))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _stars(batches):
    """Edges from each member of a bucket to the smallest member it is connected with."""
    for batch in batches:
        low, high = [], []
        for tag, members in zip(batch.column("tag").to_pylist(), batch.column("members").to_pylist(), strict=True):
            start = tag // 2 * SEGMENT
            for a, b in bucket_edges(np.array(members, np.int64).view(np.uint64), start):
                low.append(a)
                high.append(b)
        pair = np.array([low, high], np.uint64).reshape(2, -1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["u", "v"])


def within(x: np.ndarray, start: int) -> np.ndarray:
    """Chain budgets from ``start``, then the full distance, of differences ``x``."""
    ring = (x << np.uint64(start)) | (x >> np.uint64(64 - start)) if start else x
    near = np.bitwise_count(ring >> np.uint64(24)) <= 1
    near &= np.bitwise_count(ring >> np.uint64(4)) <= 2
    return near & (np.bitwise_count(x) <= DISTANCE)


def bucket_edges(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    if len(members) == 2:
        return [(members.min(), members.max())] if within(members[:1] ^ members[1:], start)[0] else []
    rest, edges = np.sort(members), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = within(rest ^ front.pop(), start)
            front += list(rest[near])
            edges += [(root, x) for x in rest[near]]
            rest = rest[~near]
    return edges


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints ``fp`` within the distance."""
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(chain_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucket_id = ["tag", "mask", "fixed"]
    members = stage(
        keyed.hint("merge").join(shared, "key").select(
            F.shiftrightunsigned("key", 30).alias("tag"), F.lit(0).cast("long").alias("mask"),
            F.col("key").bitwiseAND(F.lit((1 << 30) - 1)).alias("fixed"), "fp", "n",
        ),
        "simhash-members",
    )
    edges = []
    while True:
        small = members.where(F.col("n") <= bucket).groupBy(*bucket_id).agg(F.collect_list("fp").alias("members"))
        edges.append(stage(small.select("tag", "members").mapInArrow(_stars, "u long, v long").distinct(), "simhash-edges"))
        large = members.where(F.col("n") > bucket)
        if large.isEmpty():
            break
        varying = F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")
        large = large.join(large.groupBy(*bucket_id).agg(varying), bucket_id).select("tag", "mask", "varying", "fp")
        parts = stage(large.mapInArrow(_divide, "tag long, mask long, fixed long, fp long").distinct(), "simhash-parts")
        sizes = parts.groupBy(*bucket_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = stage(parts.hint("merge").join(sizes, bucket_id), "simhash-members")
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return stage(out.distinct(), "simhash-links") if len(edges) > 1 else out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None):
    """Fingerprints and classes of near-duplicates.

    Returns (rows, classes): rows have ``row_id``, ``row`` (struct of ``payload``, by default all columns) and
    ``fp``; classes have one row for each fingerprint: ``fp``, ``component_id`` (smallest id of the component)
    and ``first_row`` (the row_id that stands for the component).
    """
    columns = docs.columns if payload is None else payload
    rows = stage(
        docs.select(
            F.struct(*(docs[c] for c in columns)).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text")
        ).select("row", "id", simhash("text").alias("fp"), F.monotonically_increasing_id().alias("row_id")),
        "simhash-rows",
    )
    return rows, classes(rows, links(rows.select("fp").distinct()))


def classes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each ``fp`` of ``rows``, given the edges (u, v) between fingerprints."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row_id").alias("row_id")))
    fps = rows.groupBy("fp").agg(first.alias("first"))
    labels = connected(edges)
    labelled = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    labelled = stage(labelled, "simhash-labels")
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    return labelled.hint("merge").join(heads, "label").select(
        "fp", F.col("head.id").alias("component_id"), F.col("head.row_id").alias("first_row")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: smallest id, then first row."""
    return first_rows(*near_duplicates(docs, id_col, text_col))


def first_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that stand for a class, as they were given."""
    first = found.select(F.col("first_row").alias("row_id")).distinct()
    return rows.join(first, "row_id", "left_semi").select("row.*")
