"""Alignment of the tokens of two tokenizers, and how common each linked pair of ids is.

Both tokenizers encode the text with one space before it. Every token is a range of bytes. A token points to the
token of the other side that overlaps it and reaches farthest to the right, or to itself if none reaches beyond its
end (at equal ends the first side points to the second). Successor doubling (pointer jumping) over all tokens at once
leads each to the last token of its component: components are the groups between the byte offsets where tokens of
both sides end. All tokens of a group are linked with all of the other side.

A text is cut before each run of white space that begins with a space or line end and follows something else, and
between a letter and a mark that follows no letter in any piece of the second vocabulary. No piece of the second vocabulary reaches over such a place (checked when it is
loaded) and the first one's pattern splits there, so both encode the parts as they encode the whole; parts that
return are encoded once.

1. Each row is encoded once; its numbers and its distinct linked pairs of ids, with the links of each, are written.
2. Tasks count in how many of their rows a pair is linked; Spark adds the counts up.
3. Rows meet the counts without shuffling their links: the ``KNOWN`` most common pairs, a table of bounded size,
   and the highest count of each id of the first vocabulary travel with the task. Links of all other pairs are
   joined as (row, pair, links) with the whole table of counts. No pair is left out.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens:
zeros and an empty list of groups. Each row counts as a document, repeated rows and rows without id included. An
empty table gives an empty result. Extra columns are kept apart in a struct, whatever their names.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import sys
from contextlib import contextmanager
from itertools import chain, islice, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.llm.rows import spread, whole
from citeframe.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KNOWN = 1 << 19
BATCH = 256
SPACE = "▁"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
OWN = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_SIZES = OWN[:4]
_PARTS, _LINKS, _ENCODED, _BLOCK, _LONG_TEXT, _LARGE, _PENDING = 200_000, 2_000_000, 1 << 13, 1 << 16, 1 << 20, 1 << 16, 1 << 21


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if it is printable, else as the next code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, loaded where they are used from the bytes of their files."""

    def __init__(self, first: bytes, second: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_buffer(first), SentencePieceProcessor(model_proto=second)
        self.first.encode_special_tokens = True
        symbols = byte_symbols()
        self.first_bytes = {i: bytes(symbols[c] for c in t) for t, i in self.first.get_vocab(with_added_tokens=False).items() if all(c in symbols for c in t)}
        self.second_bytes = []
        crossing, after_letter = re.compile(r"\S |.\n|\n.", re.DOTALL), re.compile(r"(?<=[^\W\d_])\W|(?<=[^\W\d_])_")
        joined: set[str] = set()
        if self.first.normalizer is not None or len({b for b in self.first_bytes.values() if len(b) == 1}) < 256:
            raise ValueError("the first vocabulary does not hold all bytes")
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            plain = piece.replace(SPACE, " ")
            special = self.second.is_control(i) or self.second.is_unknown(i) or self.second.is_byte(i)
            if not special and crossing.search(plain):
                raise ValueError(f"piece {i} of the second vocabulary reaches over white space")
            if not special:
                joined.update(after_letter.findall(plain))
            self.second_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else plain.encode())
        marks = re.escape("".join(m for m in MARKS if m not in joined))
        letters = rf"\s*[^\W\d_]++(?=[{marks} \n]|\Z)|" if marks else ""
        self.part = re.compile(rf"{letters}\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
        self.lead = self.second.encode("\n")
        if self.second_bytes[self.lead[-1]] != b"\n" or b"".join(self.second_bytes[i] for i in self.lead) != b" \n":
            raise ValueError("the second tokenizer does not begin texts with a space")
        self.first_sizes = np.zeros(max(self.first_bytes) + 1, np.int64)
        self.first_sizes[list(self.first_bytes)] = [len(x) for x in self.first_bytes.values()]
        self.second_sizes = np.array([len(x) for x in self.second_bytes])
        # ids as text, each with the three marks that may follow it and alone
        self.signs = [f"{i}{mark}" for i in range(max(len(self.first_sizes), len(self.second_sizes))) for mark in (",", "|", ";", "")]

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of parts as they are inside a text: the second tokenizer's own space is the part's, or cut off."""
        a = [e.ids for e in self.first.encode_batch_fast(parts, add_special_tokens=False)]
        b = self.second.encode([p[1:] if p[0] == " " else "\n" + p for p in parts], num_threads=1)
        cut = len(self.lead)
        for k in [k for k, p in enumerate(parts) if p[0] != " " or len(p) == 1]:
            b[k] = self.lead[:-1] if parts[k] == " " else b[k][cut:]
        return a, b


def loaded(first: bytes, second: bytes) -> Pair:
    """The pair of a worker, kept for its later tasks: this module itself travels anew with each of them."""
    held = sys.modules.setdefault("citeframe_worker_pairs", ModuleType("citeframe_worker_pairs"))
    key = hashlib.sha256(first).digest() + hashlib.sha256(second).digest()
    if getattr(held, "key", None) != key:
        held.pair, held.key = Pair(first, second), key
    return held.pair


def label(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The last token of the component of each token, first side before second side, by pointer jumping."""
    n = len(ends_a)
    to_b = np.searchsorted(ends_b, ends_a) + n
    to_a = np.searchsorted(ends_a, ends_b)
    own = np.arange(len(ends_b)) + n
    successor = np.concatenate([to_b, np.where(ends_a[to_a] > ends_b, to_a, own)]) if n else own
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor
        successor = further


class Groups:
    """Groups of parts laid end to end: of each its part, and where its tokens of either side begin and end."""

    def __init__(self, flat_a, flat_b, bytes_a, bytes_b, tokens_a):
        last = label(np.cumsum(bytes_a), np.cumsum(bytes_b))
        n = len(flat_a)
        self.a, self.b = flat_a, flat_b
        # groups follow each other, so both sides change group at the same ordinal
        self.of_a, self.of_b = (np.cumsum(np.append(False, np.diff(x) != 0)[: len(x)]) for x in (last[:n], last[n:]))
        groups = int(self.of_a[-1]) + 1 if n else 0
        self.size_a, self.size_b = np.bincount(self.of_a, minlength=groups), np.bincount(self.of_b, minlength=groups)
        self.start_a, self.start_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        self.part = np.repeat(np.arange(len(tokens_a)), tokens_a)[self.start_a]

    def links(self):
        """Linked pairs of ids of all groups, how many links each stands for, and their part; in order of the parts."""
        many = self.size_a * self.size_b
        small = np.nonzero(many <= _LARGE)[0]
        count = many[small]
        of = np.repeat(small, count)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        x, y = self.a[self.start_a[of] + inner // self.size_b[of]], self.b[self.start_b[of] + inner % self.size_b[of]]
        pairs, weight, part = [x << 32 | y], [np.ones(len(of), np.int64)], [self.part[of]]
        for g in np.nonzero(many > _LARGE)[0]:
            ids_a, n_a = np.unique(self.a[self.start_a[g] : self.start_a[g] + self.size_a[g]], return_counts=True)
            ids_b, n_b = np.unique(self.b[self.start_b[g] : self.start_b[g] + self.size_b[g]], return_counts=True)
            pairs.append((ids_a[:, None] << 32 | ids_b).ravel())
            weight.append((n_a[:, None] * n_b).ravel())
            part.append(np.full(len(pairs[-1]), self.part[g]))
        pairs, weight, part = (np.concatenate(v) for v in (pairs, weight, part))
        order = np.argsort(part, kind="stable") if len(small) < len(many) else slice(None)
        return pairs[order], weight[order], part[order]

    def written(self, tokens: np.ndarray, signs: list[str]) -> list[str]:
        """The groups of each part as text; ``tokens`` is the number of tokens of both sides of each part."""
        n, m = len(self.a), len(self.b)
        codes, marks = np.empty(n + m, np.int64), np.zeros(n + m, np.int64)
        at_a, at_b = np.arange(n) + self.start_b[self.of_a], np.arange(m) + (self.start_a + self.size_a)[self.of_b]
        codes[at_a], codes[at_b] = self.a, self.b
        marks[at_a[self.start_a + self.size_a - 1]] = 1
        marks[at_b[self.start_b + self.size_b - 1]] = 2
        ends = np.cumsum(tokens)
        marks[ends - 1] = 3
        words = list(map(signs.__getitem__, (codes * 4 + marks).tolist()))
        return ["".join(words[e - k : e]) for e, k in zip(ends.tolist(), tokens.tolist(), strict=True)]


class Table:
    """Rows of numbers that grows at its end."""

    def __init__(self, *width: int):
        self.data, self.size = np.empty((1024, *width), np.int64), 0

    def add(self, rows: np.ndarray):
        need = self.size + len(rows)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty((max(need - self.size, self.size // 2), *self.data.shape[1:]), np.int64)])
        self.data[self.size : need] = rows
        self.size = need


class Aligned(dict):
    """Part to its number; -1 for parts that do not come back byte by byte.

    ``sizes`` holds the four numbers of each part, ``text`` its groups, ``links`` and ``weights`` its links.
    """

    def __init__(self, pair: Pair):
        super().__init__()
        self.pair = pair
        self._empty()

    def _empty(self):
        self.clear()
        self.sizes, self.text, self.starts, self.links, self.weights = Table(4), [], Table(), Table(), Table()
        self.weighed = False
        self.starts.add(np.zeros(1, np.int64))

    def learn(self, parts: set[str]) -> bool:
        """Encode parts that are not known, all at once; when there is no room all is forgotten and nothing learnt."""
        if self and (len(self) + len(parts) > _PARTS or self.links.size > _LINKS):
            self._empty()
            return False
        missing = list(parts)
        for at in range(0, len(missing), _ENCODED):
            self._add(missing[at : at + _ENCODED])
        return True

    def _add(self, parts: list[str]):
        a, b = self.pair.encode(parts)
        good = self._whole(parts, b)
        if len(good) < len(parts):
            self.update((p, -1) for p in parts)
            parts, a, b = [parts[k] for k in good], [a[k] for k in good], [b[k] for k in good]
        if not parts:
            return
        tokens_a, tokens_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, tokens_a), (b, tokens_b)))
        groups = Groups(flat_a, flat_b, self.pair.first_sizes[flat_a], self.pair.second_sizes[flat_b], tokens_a)
        links, weights, of = groups.links()
        self.update(zip(parts, range(self.sizes.size, self.sizes.size + len(parts)), strict=True))
        own = np.bincount(of, weights, len(parts)).astype(np.int64)
        self.sizes.add(np.stack([tokens_a, tokens_b, np.bincount(groups.part, minlength=len(parts)), own], axis=1))
        self.text += groups.written(tokens_a + tokens_b, self.pair.signs)
        self.starts.add(self.links.size + np.searchsorted(of, np.arange(len(parts)), side="right"))
        self.links.add(links)
        if self.weighed or (weights != 1).any():
            if not self.weighed:
                self.weights.add(np.ones(self.links.size - len(links), np.int64))
                self.weighed = True
            self.weights.add(weights)

    def _whole(self, parts, b) -> list[int]:
        """The parts that the second side gives back byte by byte; the first holds all bytes and always does."""
        own = self.pair.second_bytes
        back = [b"".join([own[i] for i in ids]) for ids in b]
        return [k for k, (p, r) in enumerate(zip(parts, back, strict=True)) if p.encode() == r]

    def pairs_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of several parts, repeats counted, and the links of each."""
        kinds, times = np.unique(numbers, return_counts=True)
        begin, end = self.starts.data[kinds], self.starts.data[kinds + 1]
        count = end - begin
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        weights = np.repeat(times, count)
        return _summed(self.links.data[at], weights * self.weights.data[at] if self.weighed else weights)


def _summed(pairs: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, links = pairs[order], links[order]
    first = np.nonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])[0]
    return pairs[first], np.add.reduceat(links, first) if len(first) else links


def blocks(text: str, part: re.Pattern):
    """The parts of a space and the text, in lists of bounded length."""
    text = " " + text
    if len(text) <= _LONG_TEXT:
        yield part.findall(text)
        return
    each = (m.group() for m in part.finditer(text))
    while block := list(islice(each, _BLOCK)):
        yield block


def walk(texts, aligned: Aligned):
    """(row, numbers of parts) in order of the rows, in lists of bounded length; several rows are looked up at once."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for parts in blocks(text, aligned.pair.part) if text else ():
            held.append((row, parts))
            size += len(parts)
            if size >= _BLOCK:
                yield from _looked_up(held, aligned)
                held, size = [], 0
    yield from _looked_up(held, aligned)


def _looked_up(held, aligned):
    get, unknown = aligned.get, set()
    found = [np.fromiter(map(get, parts, repeat(-2)), np.int64, len(parts)) for _, parts in held]
    for (_, parts), numbers in zip(held, found, strict=True):
        unknown.update(parts[k] for k in np.nonzero(numbers == -2)[0].tolist())
    if unknown and not aligned.learn(unknown):
        # what was known is forgotten to make room
        aligned.learn({p for _, parts in held for p in parts})
        found = [np.full(len(parts), -2) for _, parts in held]
    for (row, parts), numbers in zip(held, found, strict=True):
        for k in np.nonzero(numbers == -2)[0].tolist():
            numbers[k] = aligned[parts[k]]
        yield row, numbers


class Row:
    """What one text adds up to, part by part."""

    def __init__(self, with_groups: bool):
        self.good, self.sizes, self.sha, self.found = True, np.zeros(4, np.int64), hashlib.sha256(), []
        self.groups = [] if with_groups else None

    def add(self, numbers: np.ndarray, aligned: Aligned):
        self.good = self.good and not (numbers < 0).any()
        if not self.good:
            self.found, self.groups = [], self.groups and []
            return
        text = (";" if self.sizes[0] else "") + ";".join([aligned.text[i] for i in numbers.tolist()])
        self.sha.update(text.encode())
        if self.groups is not None:
            self.groups.append(text)
        self.sizes += aligned.sizes.data[numbers].sum(axis=0)
        self.found.append(aligned.pairs_of(numbers))
        if len(self.found) > 8:
            self.found = [self.pairs()]

    def pairs(self):
        return self.found[0] if len(self.found) == 1 else _summed(*(np.concatenate(x) for x in zip(*self.found, strict=True)))


def encode_rows(batches, first: bytes, second: bytes, with_groups: bool):
    """Numbers of each row, and its distinct linked pairs with the links of each."""
    aligned = Aligned(loaded(first, second))
    nothing = np.zeros(0, np.int64)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        rows = [(np.zeros(4, np.int64), "", (nothing, nothing), "")] * len(texts)
        current, own = None, None
        for row, numbers in walk(texts, aligned):
            if row != current:
                current, own = row, Row(with_groups)
            own.add(numbers, aligned)
            if own.good:
                rows[row] = own
            else:
                rows[row] = None
        rows = [_finished(r, nothing) for r in rows]
        pairs = _lists([r[2][0] for r in rows], pa.int64())
        links = _lists([r[2][1] for r in rows], pa.int64())
        columns = [batch.column("row"), *(pa.array([int(r[0][c]) for r in rows], pa.int64()) for c in range(4))]
        columns += [pa.array([r[1] for r in rows], pa.string()), pairs, links]
        names = ["row", *_SIZES, "groups_sha256", "pairs", "links"]
        if with_groups:
            columns.append(pa.array([r[3] for r in rows], pa.string()))
            names.append("groups")
        yield pa.RecordBatch.from_arrays(columns, names=names)
    aligned._empty()
    del aligned
    _give_back()


def _give_back():
    """Return freed memory to the system, as a worker may idle on during later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _finished(row, nothing):
    if not isinstance(row, Row):
        return np.zeros(4, np.int64), "", (nothing, nothing), ""
    return row.sizes, row.sha.hexdigest(), row.pairs(), "".join(row.groups or ())


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), kind))


def _count_rows(batches):
    """Rows of this task that hold each pair: (pair, n), a pair possibly more than once."""
    held, size = [], 0

    def out():
        found = pa.table({"pair": pa.chunked_array(held, pa.int64())}).group_by("pair").aggregate([("pair", "count")])
        return [pa.RecordBatch.from_arrays([b.column("pair"), b.column("pair_count")], names=["pair", "n"]) for b in found.to_batches()]

    for batch in batches:
        held.append(batch.column("pairs").flatten())
        size += len(held[-1])
        if size >= _PENDING:
            yield from out()
            held, size = [], 0
    yield from out()


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): rows that hold a pair linked, and whether no pair of its first id has more."""
    counted = rows.select("pairs").mapInArrow(_count_rows, "pair long, n long")
    with _small_batches(rows.sparkSession):
        counts = stage(counted.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    tagged = counts.withColumn("a", F.shiftright("pair", 32))
    highest = tagged.groupBy("a").agg(F.max("n").alias("highest"))
    return tagged.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


LINK = T.StructType([T.StructField("pair", T.LongType()), T.StructField("links", T.LongType())])
WEIGHED = T.StructType([T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rare", T.ArrayType(LINK))])


def weigher(known: np.ndarray, counts: np.ndarray, highest_ids: np.ndarray, highest: np.ndarray):
    """Sums over the links of the known pairs of each row; its other links are listed."""

    @F.arrow_udf(WEIGHED)
    def weigh(pairs: pa.Array, links: pa.Array) -> pa.Array:
        size = pc.list_value_length(pairs).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(size)), size)
        keys, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (pairs, links))
        n = np.zeros(len(keys), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            n = np.where(known[at] == keys, counts[at], 0)
        most = highest[np.searchsorted(highest_ids, keys >> 32)] if len(keys) else n
        sums = [np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)]
        np.add.at(sums[0], of, np.where((n > 0) & (n == most), times, 0))
        np.add.at(sums[1], of, n * times)
        rare = np.nonzero(n == 0)[0]
        offsets = np.append(0, np.cumsum(np.bincount(of[rare], minlength=len(size))))
        listed = pa.StructArray.from_arrays([pa.array(keys[rare]), pa.array(times[rare])], names=["pair", "links"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed)
        return pa.StructArray.from_arrays([pa.array(sums[0]), pa.array(sums[1]), lists], names=["n_best", "count_sum", "rare"])

    return weigh


@contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH`` rows, as a row carries all pairs of its text; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align(
    docs: DataFrame, first_path: str, second_path: str, text_col: str = "text", payload: list[str] | None = None,
    known: int = KNOWN, with_groups: bool = False,
) -> DataFrame:
    """Columns of ``payload`` (by default all) and the numbers of tokens, groups and links of each row.

    ``first_path`` is a byte-level vocabulary, ``second_path`` a piece model; the driver reads them. ``n_best`` and
    ``count_sum`` are over all links; ``with_groups`` adds the groups as text, ``a1,a2|b1;a3|b2,b3``.
    """
    with open(first_path, "rb") as f, open(second_path, "rb") as g:
        first, second = f.read(), g.read()
    Pair(first, second)
    docs = docs.select(whole(docs, payload), docs[text_col].alias("text"))
    kinds = [("row", docs.schema["row"].dataType), *((c, T.LongType()) for c in _SIZES), ("groups_sha256", T.StringType())]
    kinds += [(c, T.ArrayType(T.LongType())) for c in ("pairs", "links")] + ([("groups", T.StringType())] if with_groups else [])
    schema = T.StructType([T.StructField(*kind) for kind in kinds])
    encoded = docs.mapInArrow(lambda batches: encode_rows(batches, first, second, with_groups), schema)
    with _small_batches(docs.sparkSession):
        rows = stage(encoded.withColumn("row_id", F.monotonically_increasing_id()), "alignment-rows")
    counts = stage(pair_counts(rows), "alignment-counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(known).select("pair", "n").orderBy("pair").toArrow()
    best = counts.where("best").groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).orderBy("a").toArrow()
    weigh = weigher(*(t.column(c).to_numpy().copy() for t, c in ((top, "pair"), (top, "n"), (best, "a"), (best, "n"))))
    found = rows.withColumn("w", weigh("pairs", "links")).drop("pairs", "links")
    with _small_batches(docs.sparkSession):
        found = stage(found.select("*", "w.*").drop("w"), "alignment-weighed")
    rare = found.select("row_id", F.explode("rare").alias("x")).select("row_id", "x.*").join(counts, "pair")
    rare = rare.groupBy("row_id").agg(
        F.sum(F.col("n") * F.col("links")).alias("more"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best")
    )
    out = found.join(rare, "row_id", "left")
    out = out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
    out = out.withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return spread(out, OWN + (["groups"] if with_groups else []))
