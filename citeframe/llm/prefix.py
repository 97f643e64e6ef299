"""Prefix sums over hash-random keys without gathering a group in one task.

Keys are hexadecimal strings; a prefix of a key is a range of the sorted order. Ranges of about ``RANGE`` rows are
summed, and sums of 256 neighbouring ranges at a time are turned into offsets, level by level up to the whole
group. Rows then need only a running sum inside their own range. Groups of any size, a hot one included, thus
spread over as many ranges as they need.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = 1024


def digits_for(rows: int) -> int:
    """Length of the prefixes that name ranges of at most about ``RANGE`` of ``rows`` rows."""
    return max(0, math.ceil(math.log(max(rows, 1) / RANGE, 16) - 1e-9))


def running(
    rows: DataFrame, group: str, key: str, value: str, digits: int, ties: list[str], out: str = "start", counted: DataFrame | None = None
) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, in order of ``key`` and ``ties``, per ``group``.

    ``counted`` may be a narrow written copy of ``rows`` from which the ranges are summed.
    """
    rows = rows.withColumn("_range", F.substring(key, 1, digits))
    narrow = rows if counted is None else counted.withColumn("_range", F.substring(key, 1, digits))
    sums = narrow.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    offsets = _offsets(sums, group, digits)
    inner = Window.partitionBy(group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, [group, "_range"])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_range", "_before")


def _offsets(sums: DataFrame, group: str, digits: int) -> DataFrame:
    up = max(digits - 2, 0)
    sums = sums.withColumn("_up", F.substring("_range", 1, up))
    before = Window.partitionBy(group, "_up").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    local = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if up > 0:
        parents = sums.groupBy(group, F.col("_up").alias("_range")).agg(F.sum("_sum").alias("_sum"))
        above = _offsets(parents, group, up).select(group, F.col("_range").alias("_up"), F.col("_before").alias("_above"))
        local = local.join(above, [group, "_up"]).withColumn("_before", F.col("_before") + F.col("_above"))
    return local.select(group, "_range", "_before")
