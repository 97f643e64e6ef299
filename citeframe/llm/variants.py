"""Spelling variants by dense prefix-suffix tiling.

Two words are near when one inserted, deleted or replaced code point turns one into the other, that is when their
common prefix and common suffix together reach the longer length minus one. Words are laid as padded matrices of
code points, once from the left and once from the right; blocks of rows are compared column by column, all pairs of
a block at once, which gives both lengths.

Only blocks that can hold near words are compared. With ``L`` the shorter length, the edit lies in one of ``PIECES``
pieces of the word and everything around the piece agrees: that surrounding (and ``L``) is the key of a block, and a
word is in the blocks of its own length and of one less. A pair found in several blocks counts only in the block
whose piece holds its first possible edit. Blocks above ``TILE`` are divided again by pieces of their piece until
they are small enough or the piece is one code point, when all members but their one or two free code points are
alike. So no block grows with the table, no pair leaves its task (each task adds up what a word has in its blocks),
and nothing is cut off.

Words with a form follow it to a root; as a form is at least ``RATIO`` times as common, chains are short, and
successor doubling ends after a few joins.

Defined cases: null and empty texts have no words; a null id is written ``null``. Words of any length and script
are compared whole. Repeated rows count as often as they occur. An empty table gives an empty result. Extra columns
are left out by name.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
PIECES = 4
TILE, TILE_CELLS = 1024, 1 << 17
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BLOCK = ["base", "low", "high", "around"]
_PENDING, _LONG_TEXT, _ROWS, _CELLS, _DIAGONAL = 400_000, 1 << 20, 1 << 15, 1 << 22, 24


def runs(text: str):
    """Runs of letters with A-Z in lower case, in lists of bounded length."""
    low = text.encode("utf-8", "replace").lower().decode()
    if len(low) <= _LONG_TEXT:
        yield RUN.findall(low)
        return
    each = (m.group() for m in RUN.finditer(low))
    while block := list(islice(each, 1 << 16)):
        yield block


def misspelt(doc_id: str, run: str, every: int = 97) -> str:
    """The run without one code point when the checksum of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches, change, least):
    total: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for block in runs(text or ""):
                for run, n in Counter(block).items():
                    word = change(doc_id, run) if change else run
                    if len(word) >= least:
                        total[word] += n
            if len(total) >= _PENDING:
                yield out()
                total.clear()
    yield out()


def word_counts(
    docs: DataFrame, id_col="doc_id", text_col="text", change: Callable[[str, str], str] | None = None,
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n): runs of letters of all texts, after ``change(id, run)``, that are long and frequent enough."""
    texts = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("null")).alias("id"), docs[text_col].alias("text"))
    counted = texts.mapInArrow(lambda batches: _count(batches, change, min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame, base, low, high, pieces: int) -> DataFrame:
    """(word, n, base, low, high, around): the blocks of the pieces of ``low`` to ``high`` of each row."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(pieces)), lambda j: low + F.floor((high - low) * j / pieces).cast("int"))
    parts = F.transform(F.sequence(F.lit(1), F.lit(pieces)), lambda j: F.struct(F.get(F.col("cuts"), j - 1).alias("low"), F.get(F.col("cuts"), j).alias("high")))
    rows = rows.withColumn("base", base).withColumn("cuts", cuts)
    rows = rows.select("word", "n", "base", F.explode(parts).alias("p")).where("p.low < p.high").select("word", "n", "base", "p.*")
    around = F.xxhash64(F.expr("substring(word, 1, low)"), F.expr("right(word, base - high)"))
    return rows.withColumn("around", around)


def left_right(words: list[str]):
    """Code points padded on the right, then counted from the end, and lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = max(int(sizes.max()), 1)
    left = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    if left.max() < 256:
        left = left.astype(np.uint8)
    back = sizes[:, None] - 1 - np.arange(width)
    right = np.where(back >= 0, np.take_along_axis(left, np.maximum(back, 0), axis=1), 0)
    return left, right.astype(left.dtype), sizes


def common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Leading columns in which two blocks of rows agree, at most ``limit``."""
    same = np.ones(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), bool)
    length = np.zeros(same.shape, np.int32)
    for c in range(a.shape[-1]):
        same &= a[..., c] == b[..., c]
        if not same.any():
            break
        length += same
    return np.minimum(length, limit)


def single_edits(la, ra, na, lb, rb, nb, base, low, high) -> np.ndarray:
    """Which pairs of two blocks are one edit apart, with the first possible edit inside the piece."""
    short, long = np.minimum(na, nb), np.maximum(na, nb)
    prefix, suffix = common(la, lb, short), common(ra, rb, short)
    near = (short == base) & (prefix + suffix >= long - 1) & (long - short <= 1) & ~((long == short) & (prefix == long))
    edit = np.where(long == short, prefix, base - suffix)
    return near & (low <= edit) & ((edit < high) | (edit == base) & (high == base))


def _pairs(left, right, sizes, group, base, low, high):
    """Near pairs (i, j) of rows sorted by group: small groups along diagonals, others in square tiles."""
    starts = np.nonzero(np.append(True, group[1:] != group[:-1]))[0]
    counts = np.diff(np.append(starts, len(group)))
    small = np.repeat(counts <= _DIAGONAL, counts)
    for step in range(1, int(counts[counts <= _DIAGONAL].max(initial=0))):
        i = np.nonzero(small[:-step] & (group[:-step] == group[step:]))[0]
        j = i + step
        hit = single_edits(left[i], right[i], sizes[i], left[j], right[j], sizes[j], base[i], low[i], high[i])
        yield i[hit], j[hit]
    for s, n in zip(starts[counts > _DIAGONAL].tolist(), counts[counts > _DIAGONAL].tolist(), strict=True):
        block = max(1, _CELLS // n)
        for at in range(s, s + n, block):
            i, j = np.arange(at, min(at + block, s + n)), np.arange(at, s + n)
            hit = single_edits(
                left[i, None], right[i, None], sizes[i, None], left[None, j], right[None, j], sizes[None, j], base[s], low[s], high[s]
            ) & (i[:, None] < j)
            a, b = np.nonzero(hit)
            yield i[a], j[b]


def _compare(table: pa.Table) -> pa.RecordBatch:
    """What each row has in its block: near words, and the commonest of them."""
    order = pc.sort_indices(table, sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    left, right, sizes = left_right(table.column("word").to_pylist())
    base, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("base", "low", "high"))
    around = table.column("around").to_numpy()
    change = (base[1:] != base[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (around[1:] != around[:-1])
    group = np.append(0, np.cumsum(change))
    count, best = np.zeros(len(order), np.int64), np.full(len(order), len(order))
    for i, j in _pairs(left, right, sizes, group, base, low, high):
        count += np.bincount(i, minlength=len(count)) + np.bincount(j, minlength=len(count))
        np.minimum.at(best, i, rank[j])
        np.minimum.at(best, j, rank[i])
    found = np.nonzero(count)[0]
    near = table.take(pa.array(order[best[found]]))
    return pa.RecordBatch.from_arrays(
        [table.column("word").take(pa.array(found)).combine_chunks(), pa.array(count[found]), near.column("n").combine_chunks(), near.column("word").combine_chunks()],
        names=["word", "near", "best_n", "best"],
    )


def _tiles(batches):
    """Rows of a partition sorted by block; whole blocks are compared a bounded number of cells at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        width = pc.max(pc.utf8_length(batch.column("word"))).as_py() or 1
        if rows >= _ROWS or rows * width >= _CELLS * 4:
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in _BLOCK]
            change = np.nonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))[0]
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield _compare(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
    if rows:
        yield _compare(pa.Table.from_batches(held))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near ones; ``best`` is the commonest of them."""
    spark = words.sparkSession
    both = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("shorter")).where("shorter > 0")
    level = _keyed(both, F.col("shorter"), F.lit(0), F.col("shorter"), PIECES)
    done = []
    while True:
        sizes = level.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("members"), F.min(F.length("word")).alias("least"))
        # a block without a word of the shorter length has no pairs of its own
        sizes = sizes.where("members > 1 and least = base").drop("least")
        level = stage(level.join(sizes, _BLOCK), "variants-blocks")
        fits = (F.col("members") <= tile) & (F.col("members") * F.col("base") <= TILE_CELLS) | (F.col("high") - F.col("low") == 1)
        small = level.where(fits).select("word", "n", *_BLOCK)
        tasks = max(spark.sparkContext.defaultParallelism, small.count() // (_ROWS * 4) + 1)
        small = small.repartition(tasks, *_BLOCK).sortWithinPartitions(*_BLOCK)
        done.append(stage(small.mapInArrow(_tiles, "word string, near long, best_n long, best string"), "variants-near"))
        large = level.where(~fits)
        if large.isEmpty():
            break
        level = _keyed(large, F.col("base"), F.col("low"), F.col("high"), PIECES)
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("b"))
    return found.select("word", "n_near", "b.best", (-F.col("b.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where words (word, form) come out, by successor doubling; chains must not be circles."""
    hops = stage(links.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = hops.join(further, "root", "left")
        moved = stage(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return hops


def variants(words: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the distinct words (word, n)."""
    words = stage(words.select("word", "n"), "variants-words")
    near = words.join(near_words(words, tile), "word", "left")
    common_enough = F.col("best_n") >= ratio * F.col("n")
    forms = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common_enough, F.col("best")).alias("form"),
        F.when(common_enough, F.col("best_n")).alias("form_n"),
    )
    forms = stage(forms, "variants-forms")
    found = roots(forms.where("form is not null"))
    return forms.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
