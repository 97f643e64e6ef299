"""Search-performance exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe import constants as C
from citeframe.functions import urls as U
from citeframe.functions.numbers import csv_number
from citeframe.sources.csv_splits import read_table


def check_search_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type the five text columns; rows with a bad url or number go to the rejects with the reason."""
    numbers = ["clicks", "impressions", "ctr", "position"]
    df = raw.withColumn("page", F.trim("page")).filter(
        F.length(F.concat_ws("", "page", *numbers)) > 0
    )
    # a generator reads each number once; as plain expressions the filters below would read them again and again
    typed = df.select("*", F.inline(F.array(F.struct(*(csv_number(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in numbers)))))
    reason = F.when(F.length(F.coalesce("page", F.lit(""))) == 0, F.lit("page is missing"))
    reason = reason.when(~F.coalesce(F.col("page").rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$"), F.lit(False)), F.lit("page is no url"))
    for c in numbers:
        reason = reason.when(F.col(f"_{c}").isNull(), F.lit(f"{c} is no number of 0 or more"))
    typed = typed.withColumn("reason", reason)
    keys = [c for c in raw.columns if c not in C.SEARCH_COLUMNS]
    good = typed.filter("reason IS NULL").select(*keys, "page", *[F.col(f"_{c}").alias(c) for c in numbers])
    return good, typed.filter("reason IS NOT NULL").select(*keys, *C.SEARCH_COLUMNS, "reason")


def read_search_csv(spark: SparkSession, path: str, site_id: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of an export: header in any order and case, quoted fields and line breaks, doubled quotes, BOM.

    Files are split among tasks even where quoted fields hold line breaks. ``row_no`` follows position through all
    files, which the last-page rule of the aggregation needs. A record whose quote is never closed is a reject.
    """
    rows, unclosed = read_table(spark, path, C.SEARCH_COLUMNS)
    own = [F.lit(site_id).alias("site_id"), F.lit(source).alias("source"), "row_no"]
    good, bad = check_search_rows(rows.select(*own, *C.SEARCH_COLUMNS))
    texts = [F.col("text").alias(c) if c == "page" else F.lit(None).cast("string").alias(c) for c in C.SEARCH_COLUMNS]
    return good, bad.unionByName(unclosed.select(*own, *texts, F.lit("quote is never closed").alias("reason")))


def comparable_pages(rows: DataFrame) -> DataFrame:
    """Adds the search form of each page url and its domain."""
    return rows.withColumn("search_key", U.search_url(F.col("page"))).withColumn("domain", U.url_domain(F.col("page")))
