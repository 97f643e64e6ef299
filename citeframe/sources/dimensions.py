"""Brands, facts, competitors and prompts, with validation and defaults."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.schemas import schema

# fixed values: columns that must be filled, per table
REQUIRED = {
    "brands": ["site_id", "name", "domain", "category", "one_liner"],
    "brand_facts": ["site_id", "fact_id", "fact_type", "text"],
    "competitors": ["site_id", "name"],
    "prompts": ["site_id", "prompt_id", "category", "template", "expected_signal"],
}
PRIORITIES = ["high", "medium", "low"]
ARRAYS = {"brands": ["personas", "use_cases", "trusted_domains"]}


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split a dimension table into valid rows with defaults and rejected rows with every failing field."""
    problems: list[Column] = [
        F.when(F.length(F.coalesce(c, F.lit(""))) == 0, F.lit(f"{c}: must not be empty")) for c in REQUIRED[table]
    ]
    if table == "prompts":
        bad = F.col("priority").isNotNull() & ~F.col("priority").isin(PRIORITIES)
        problems.append(F.when(bad, F.lit("priority: must be high, medium or low")))
    checked = df.withColumn("errors", F.filter(F.array(*problems), lambda p: p.isNotNull()))
    fill = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ARRAYS.get(table, [])}
    good = checked.filter(F.size("errors") == 0).drop("errors").withColumns(fill)
    return good, checked.filter(F.size("errors") > 0)


def load_dimensions(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """Read the four dimension tables (JSON lines, one folder or file per table).

    With ``strict`` a table with invalid rows raises and names the first of them; otherwise those
    rows come back under ``<table>_rejects``.
    """
    out: dict[str, DataFrame] = {}
    for table in REQUIRED:
        raw = spark.read.schema(schema(table)).json(os.path.join(path, table))
        good, bad = validate(raw, table)
        if strict:
            found = bad.select("site_id", "errors").limit(10).collect()
            if found:
                shown = "; ".join(f"{r.site_id}: {', '.join(r.errors)}" for r in found)
                raise ValueError(f"invalid {table}: {shown}")
        out[table], out[f"{table}_rejects"] = good, bad
    return out
