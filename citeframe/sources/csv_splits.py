"""CSV files with quoted line breaks, read by many tasks.

A line break ends a record only outside quotes, and whether a split of a file begins inside quotes depends on all
before it. Every task counts for its splits the quotes and how many records begin there, once for either beginning;
one row per split goes to the driver, where running parities and sums give every split its true beginning and the
number of its first record. Splits are then read again, now each for itself. Records of one line, nearly all, are
complete where they are read; only lines of longer records are brought together, by (file, record).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_READ = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
_LINES = "file string, record long, split long, line_no long, line string, whole boolean, open boolean"


def _runs(batch: pa.RecordBatch):
    """Neighbouring lines of one split: (file, split, lines, quotes of each, blank or not)."""
    files, splits, lines = batch.column("file"), batch.column("split").to_numpy(), batch.column("value")
    kinds = files.dictionary_encode()
    change = (np.diff(splits) != 0) | (np.diff(kinds.indices.to_numpy()) != 0)
    cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), len(batch)]
    for at, to in zip(cuts, cuts[1:], strict=False):
        if to > at:
            own = lines.slice(at, to - at)
            quotes = pc.count_substring(own, '"').to_numpy(zero_copy_only=False).astype(np.int64)
            blank = pc.equal(pc.utf8_length(pc.utf8_trim(own, characters=" \t\ufeff")), 0).to_numpy(zero_copy_only=False)
            yield files[at].as_py(), int(splits[at]), own, quotes, blank


def _inside(quotes: np.ndarray, begins: int) -> np.ndarray:
    """Whether each line begins inside quotes, then whether the line after the last one does."""
    return np.append(begins, (begins + np.cumsum(quotes)) % 2).astype(bool)


def _split_counts(batches):
    """(file, split, parity, outside, inside): quotes of a split, and records begun in it for either beginning."""
    state: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, split, _, quotes, blank in _runs(batch):
            parity, *begun = state.get((file, split), (0, 0, 0))
            for h in (0, 1):
                inside = _inside(quotes, (parity + h) % 2)
                begun[h] += int((~inside[:-1] & ~blank).sum())
            state[file, split] = [(parity + int(quotes.sum())) % 2, *begun]
    rows = [(f, s, *v) for (f, s), v in state.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.string(), *[pa.int64()] * 4)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "split", "parity", "outside", "inside"])


def _beginnings(counts) -> tuple[dict[tuple[str, int], tuple[int, int]], dict[str, tuple[int, int]]]:
    """Each split's beginning (inside quotes or not, records before) and each file's end, by running sums."""
    begin, end = {}, {}
    for r in sorted(counts, key=lambda r: (r["file"], r["split"])):
        inside, records = end.get(r["file"], (0, 0))
        begin[r["file"], r["split"]] = (inside, records)
        end[r["file"]] = ((inside + r["parity"]) % 2, records + (r["inside"] if inside else r["outside"]))
    return begin, end


def _record_lines(batches, begin, end):
    """Lines with the number of their record; ``open`` marks the first line of a record whose quote is never closed."""
    at: dict[tuple[str, int], tuple[int, int, int]] = {}
    for batch in batches:
        for file, split, lines, quotes, blank in _runs(batch):
            inside, records, line_no = at.get((file, split), (*begin[file, split], 0))
            within = _inside(quotes, inside)
            starts = ~within[:-1] & ~blank
            record = records + np.cumsum(starts) - 1
            whole = starts & ~within[1:]
            at[file, split] = (int(within[-1]), records + int(starts.sum()), line_no + len(lines))
            unclosed, last = end[file]
            lost = (record == last - 1) & bool(unclosed) & ~whole
            keep = (starts | within[:-1]) & (~lost | starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(lines), pa.string()), pa.array(record), pa.array(np.full(len(lines), split)),
                 pa.array(np.arange(line_no, line_no + len(lines))), lines, pa.array(whole), pa.array(lost)],
                names=["file", "record", "split", "line_no", "line", "whole", "open"],
            ).filter(pa.array(keep))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """((file, record, text, open), records of each file): complete records of all files below ``path``.

    Blank lines between records do not count. A record whose quote is never closed would swallow the rest of its
    file: it is kept as its first line, marked ``open``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )
    counts = lines.mapInArrow(_split_counts, "file string, split long, parity long, outside long, inside long")
    # a task may meet a split's lines in one piece only, so there is one row for each split
    begin, end = _beginnings(counts.toArrow().to_pylist())
    found = lines.mapInArrow(lambda batches: _record_lines(batches, begin, end), _LINES)
    alone = F.col("whole") | F.col("open")
    single = found.where(alone).select("file", "record", F.col("line").alias("text"), "open")
    parts = found.where(~alone).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "line_no", "line"))).alias("lines"))
    joined = parts.select("file", "record", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.lit(False).alias("open"))
    return single.unionByName(joined), {f: n for f, (_, n) in end.items()}


def read_table(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (row_no, columns) of CSV files that begin with a header, and records (row_no, text) that never end.

    Headers are matched by name in any order and case, file by file. ``row_no`` counts records through all files in
    order of their names, so it follows file position. Raises ``ValueError`` when a file lacks a column.
    """
    records, sizes = read_records(spark, path)
    texts = [(r.file, r.text) for r in records.where(F.col("record") == 0).select("file", "text").collect()]  # one row per file
    width = max((text.count(",") + 1 for _, text in texts), default=1)
    kind = ", ".join(f"c{i} string" for i in range(width))

    def cells(df: DataFrame, text: Column) -> DataFrame:
        # a generator parses once per row; as a plain expression every filter and column behind it would parse again
        split = df.select("*", F.inline(F.array(F.from_csv(text, kind, _READ))))
        return split.withColumn("cells", F.array(*(f"c{i}" for i in range(width))))

    heads = cells(spark.createDataFrame(texts, "file string, text string"), F.regexp_replace("text", "^\ufeff", ""))
    heads = heads.select("file", F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))).alias("names"))
    named = {r.file: r.names for r in heads.collect()}
    lacking = next((x for names in named.values() if (x := [c for c in columns if c not in names])), [])
    if lacking or not sizes:
        raise ValueError(f"search export lacks the columns {', '.join(lacking or columns)}")
    offsets, total = [], 0
    for file in sorted(sizes):
        offsets.append((file, total, named.get(file)))
        total += sizes[file] - 1
    places = spark.createDataFrame(offsets, "file string, before long, names array<string>")
    # one row per file: shuffled instead, all rows of a file would meet in one task
    body = records.where(F.col("record") > 0).join(F.broadcast(places), "file").withColumn("row_no", F.col("before") + F.col("record") - 1)
    rows = cells(body.where(~F.col("open")).select("row_no", "names", "text"), F.col("text"))
    picked = [F.get("cells", F.array_position("names", c).cast("int") - 1).alias(c) for c in columns]
    return rows.select("row_no", *picked), body.where("open").select("row_no", "text")
