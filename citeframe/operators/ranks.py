"""Exact ranks inside groups of any size.

A window over a group sorts the whole group in one task. Here rows are dealt by sampled ranges of (group, order), so
that a large group spreads over as many ranges as its share asks for. Every row has its position within its range;
one row for each (range, group) tells how many rows the group has there and where they begin, and prefix sums of
those counts, as many per group as it has ranges, turn positions into ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeframe.operators.joins import lookup_join
from citeframe.session import stage

_ROW_BITS = 33  # of the ids that Spark gives rows: the range's number above, the position within it below


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with the rank (from 1) of each row of its group in ``order``, which must tell rows of a group apart.

    Null groups are one group. Rows are written once, so the ranges hold when executors are lost.
    """
    spread = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = stage(spread.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumns({"_range": F.shiftright("_id", _ROW_BITS), "_place": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_g{i}") for i, c in enumerate(group)]
    kept += [F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(group)]
    keys = [f"_g{i}" for i in range(len(group))] + [f"_n{i}" for i in range(len(group))]
    rows = rows.select("*", *kept)
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    joined = lookup_join(rows, counts.select(*keys, "_range", "_first", "_before"), [*keys, "_range"])
    rank = (F.col("_before") + F.col("_place") - F.col("_first") + 1).cast("int")
    return joined.withColumn(out, rank).select(*df.columns, out)
