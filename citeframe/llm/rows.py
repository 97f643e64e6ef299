"""Rows kept apart from an operator's own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns, or ``columns``, as one struct, so that no name clashes with an operator's own."""
    return F.struct(*(df[c] for c in (df.columns if columns is None else columns))).alias("row")


def spread(df: DataFrame, own: list[str]) -> DataFrame:
    """The struct ``row`` as columns again, then ``own``; an input column of the same name gets ``_in`` added."""
    names, taken = df.schema["row"].dataType.names, set(own)
    out = []
    for name in names:
        new = name
        while new in taken:
            new += "_in"
        taken.add(new)
        out.append(F.col("row")[name].alias(new))
    return df.select(*out, *own)
