"""Repeated spans of words by a compacted de Bruijn graph over sampled k-mers.

A window is 35 consecutive words; one that also starts anywhere else is repeated. The graph's nodes are 8-word
k-mers, sampled so that every window holds one that its own words determine: the first of the smallest hash among
its 28 k-mers. Neighbouring windows with the same sampled k-mer are a run, and a run's span is all words of its
windows. A node is plain when it occurs at least twice and all its occurrences have the same span around it: its
path does not branch there, so the paths through it are one.

1. Every text gives its nodes, the hash of the span of each and how many windows it stands for.
2. One aggregate over nodes counts them and tells plain ones; a join hands that to the occurrences. Windows of
   nodes that occur once are not repeated; those of plain nodes are, along the whole path.
3. At branches the spans are verified: all windows of a span that occurs twice with its node are repeated.
4. Only the windows of spans that occur once with a repeated node are left. Their texts are read again, and they
   are verified one by one by 128-bit hashes, counted with those of one source of each other span of the node.
5. Texts that lose words are read once more for what is kept; the rest was settled in step 1.

Nodes are joined and counted, never gathered; a passage in a third of all texts is a hot key of a join with a unique
side, which Spark splits. Texts meet their runs by a key of their content, so equal rows need no identity, and a
Bloom filter of the keys leaves out the other texts before they are shuffled.

Defined cases: null texts count as empty. Texts of fewer than 35 words keep all. Repeated rows repeat each other's
windows. Null ids are rows like any other; an empty table gives an empty result. Extra columns are left out by name.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.operators.bloom import bloom_of
from citeframe.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 35
KMER = 8
SPAN = WINDOW - KMER + 1
REPEATED, OPEN, WITNESS = 1, 2, 3
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BATCH_WORDS = 300_000
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    old = _powers.get(base)
    if old is None or len(old[0]) < n:
        size = max(n, _BATCH_WORDS)
        old = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            old.append(np.cumprod(steps))
        _powers[base] = old = tuple(old)
    return old


class Rolling:
    """Hashes of any span of a run of word hashes, from prefix sums."""

    def __init__(self, hashes: np.ndarray, base: int):
        up, self.down = _power(base, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def fixed(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _first_least(kmers: np.ndarray) -> np.ndarray:
    """Where the first smallest of each ``SPAN`` neighbours is, by doubling."""
    best, at, width = kmers, np.arange(len(kmers)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        later = best[step:] < best[:-step]
        best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    return at


def runs(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Runs of windows of texts laid end to end: their sampled k-mer and span by hash, first window, number, text."""
    rolling = Rolling(hashes, _ODD[0])
    kmers = rolling.fixed(KMER)
    place = _first_least(kmers)
    inside = np.zeros(len(hashes) + 1, np.int64)
    long = ends - starts >= WINDOW
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - WINDOW + 1, -1)
    windows = np.nonzero(np.cumsum(inside)[: len(place)])[0]
    place = place[windows]
    begin = np.nonzero(np.append(True, place[1:] != place[:-1]))[0] if len(place) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(place)))
    first, node = windows[begin], place[begin]
    shape = ((node - first) * WINDOW + size).astype(np.uint64)
    other = Rolling(_mix(hashes ^ np.uint64(_ODD[1])), _ODD[1])
    span = _mix(other.spans(first, first + size - 1 + WINDOW) ^ _mix(shape + np.uint64(1)))
    return kmers[node], span, first, size, np.searchsorted(ends, first, side="right")


def _groups(texts: pa.Array):
    """Word lists of several texts at a time."""
    group, size = [], 0
    for text in texts:
        group.append(split(text.as_py()))
        size += len(group[-1])
        if size >= _BATCH_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _laid(group):
    lengths = np.array([len(w) for w in group], np.int64)
    ends = np.cumsum(lengths)
    return word_hashes([w for words in group for w in words]), ends - lengths, ends


NODES = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("whole", T.BinaryType())]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("node", "span")] + [T.StructField("size", T.ArrayType(T.ByteType()))]
)
_NODES = pa.struct([("n_words", pa.int64()), ("whole", pa.binary()), ("node", pa.list_(pa.int64())), ("span", pa.list_(pa.int64())), ("size", pa.list_(pa.int8()))])


@F.arrow_udf(NODES)
def nodes(texts: pa.Array) -> pa.Array:
    """Number of words and hash of all words of each text, and its runs: k-mer, span, number of windows."""
    out = []
    for group in _groups(texts):
        hashes, starts, ends = _laid(group)
        if len(hashes) >= WINDOW:
            node, span, _, size, of = runs(hashes, starts, ends)
            cuts = np.searchsorted(of, np.arange(len(group) + 1))
        else:
            node = span = size = np.zeros(0, np.int64)
            cuts = np.zeros(len(group) + 1, np.int64)
        for k, words in enumerate(group):
            own = slice(cuts[k], cuts[k + 1])
            whole = hashlib.sha256(b" ".join(words)).digest()
            out.append({"n_words": len(words), "whole": whole, "node": node[own].view(np.int64), "span": span[own].view(np.int64), "size": size[own].astype(np.int8)})
    return pa.array(out, _NODES)


def _covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words are covered by windows that start at the given places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, windows, 1)
    np.add.at(change, np.minimum(windows + WINDOW, n), -1)
    return np.cumsum(change)[:n] > 0


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.nonzero(edge == 1)[0].astype(np.int32), np.nonzero(edge == -1)[0].astype(np.int32)


def _windows(size: list[int], marks: list[int], kinds) -> np.ndarray:
    """First words of the windows of the runs that are marked (4 times the run, plus the kind) as one of ``kinds``."""
    ends = np.cumsum(np.array(size, np.int64))
    marks = np.array(marks, np.int64)
    own = np.unique(marks[np.isin(marks % 4, kinds)] // 4)
    found = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(found, ends[own] - np.array(size, np.int64)[own], 1)
    np.add.at(found, ends[own], -1)
    return np.nonzero(np.cumsum(found))[0]


HASHED = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))


@F.arrow_udf(HASHED)
def window_hashes(texts: pa.Array, sizes: pa.Array, marks: pa.Array) -> pa.Array:
    """128-bit hashes of the windows of open runs and of witnesses."""
    out = []
    for text, size, mark in zip(texts, sizes, marks, strict=True):
        at = _windows(size.as_py(), mark.as_py(), (OPEN, WITNESS))
        hashes = word_hashes(split(text.as_py()))
        h1, h2 = (Rolling(h, base).spans(at, at + WINDOW).view(np.int64) for h, base in ((hashes, _ODD[0]), (_mix(hashes ^ np.uint64(_ODD[1])), _ODD[1])))
        out.append([{"at": a, "h1": x, "h2": y} for a, x, y in zip(at.tolist(), h1.tolist(), h2.tolist(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])))


DONE = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")])


@F.arrow_udf(DONE)
def finish(texts: pa.Array, sizes: pa.Array, marks: pa.Array, verified: pa.Array) -> pa.Array:
    """Ranges of words covered by windows of repeated runs and by verified windows, and the hash of the other words."""
    out = []
    for text, size, mark, more in zip(texts, sizes, marks, verified, strict=True):
        words = split(text.as_py())
        windows = _windows(size.as_py(), mark.as_py(), (REPEATED,))
        removed = _covered(np.concatenate([windows, np.array(more.as_py() or [], np.int64)]), len(words))
        first, last = _ranges(removed)
        kept = [w for w, gone in zip(words, removed.tolist(), strict=True) if not gone]
        out.append({"n_removed": int(removed.sum()), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(), "starts": first, "ends": last})
    kind = pa.struct([("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    return pa.array(out, kind)


def marked_runs(sampled: DataFrame) -> DataFrame:
    """(row_id, mark): runs of repeated windows, open runs, and witnesses, as 4 times the run's number plus the kind."""
    occurrences = sampled.select("row_id", F.posexplode(F.arrays_zip("node", "span")).alias("run", "o")).select("row_id", "run", "o.*")
    graph = occurrences.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("low"), F.max("span").alias("high"))
    graph = graph.where("n > 1").select("node", (F.col("low") == F.col("high")).alias("plain"))
    met = occurrences.join(graph, "node").select(
        "row_id", "run", F.when(~F.col("plain"), F.col("node")).alias("node"), F.when(~F.col("plain"), F.col("span")).alias("span")
    )
    met = stage(met, "substring-met")
    branches = met.where("node is not null")
    spans = branches.groupBy("node", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "run")).alias("first"))
    spans = stage(spans, "substring-spans")
    mixed = spans.where("n = 1").select("node").distinct()
    sources = spans.join(mixed, "node").select("first.row_id", (F.col("first.run") * 4 + F.when(F.col("n") == 1, OPEN).otherwise(WITNESS)).alias("mark"))
    twice = branches.join(spans.where("n > 1").select("node", "span"), ["node", "span"])
    repeated = met.where("node is null").select("row_id", "run").union(twice.select("row_id", "run"))
    return repeated.select("row_id", (F.col("run") * 4 + REPEATED).alias("mark")).union(sources)


def _texts_of(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """One text for each ``key`` of ``keyed``, which has each key once; other texts are left out before the shuffle."""
    wanted = texts.where(bloom_of(keyed, ["key"]).may_hold("key"))
    return wanted.groupBy("key").agg(F.any_value("text").alias("text")).join(keyed, "key")


def repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, starts, ends): word ranges covered by repeated windows, for each row."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")
    texts = rows.select(key, "text")
    sampled = rows.select("id", key, nodes("text").alias("s")).select("id", "key", "s.*", F.monotonically_increasing_id().alias("row_id"))
    sampled = stage(sampled, "substring-nodes")
    marks = marked_runs(sampled).groupBy("row_id").agg(F.collect_set("mark").alias("marks"))
    marks = marks.join(sampled.select("row_id", "key", "size"), "row_id")
    # rows with the same text have the same runs
    keyed = marks.groupBy("key").agg(F.any_value("size").alias("size"), F.array_distinct(F.flatten(F.collect_set("marks"))).alias("marks"))
    keyed = stage(keyed, "substring-keys")
    open_keys = keyed.where(F.exists("marks", lambda m: m % 4 != REPEATED))
    windows = _texts_of(texts, open_keys).select("key", F.explode(window_hashes("text", "size", "marks")).alias("w")).select("key", "w.*")
    windows = stage(windows, "substring-windows")
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    verified = windows.join(twice, ["h1", "h2"]).groupBy("key").agg(F.collect_set("at").alias("verified"))
    losing = keyed.join(verified, "key", "left").where(F.col("verified").isNotNull() | F.exists("marks", lambda m: m % 4 == REPEATED))
    losing = stage(losing, "substring-losing")
    done = stage(_texts_of(texts, losing).select("key", finish("text", "size", "marks", "verified").alias("d")).select("key", "d.*"), "substring-done")
    none = F.array().cast("array<int>")
    return sampled.select("id", "key", "n_words", "whole").join(done, "key", "left").select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("whole"))).alias("kept_sha256"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"),
    )
