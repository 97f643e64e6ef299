"""Score arithmetic (native columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(x + F.lit(0.5))


def round_percent(x: Column) -> Column:
    return half_up(x * 100).cast("int")


def round_score(x: Column) -> Column:
    """Two decimals, halves upwards."""
    return half_up(x * 100) / F.lit(100.0)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def rank_score(rank: Column) -> Column:
    """1, .75, .5, .25 for the first four places, 0 below, NULL when there is no rank."""
    return (
        F.when(rank.isNull(), F.lit(None).cast("double"))
        .when(rank <= 4, F.lit(1.25) - rank * F.lit(0.25))
        .otherwise(F.lit(0.0))
    )


def csv_number(c: Column) -> Column:
    """Blank is 0, a percent sign is dropped; NULL when the text is no finite number of 0 or more."""
    bare = F.trim(F.regexp_replace(c, "%", ""))
    value = F.when(F.length(bare) == 0, F.lit(0.0)).when(
        bare.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double")
    )
    return F.when((value >= 0) & (value < F.lit(float("inf"))), value)


def config_hash(*inputs: Column) -> Column:
    """First 16 hex digits of a SHA-256 over the inputs as one JSON object."""
    return F.left(F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256), F.lit(16))
