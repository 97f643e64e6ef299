"""Registry of the queries and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import derive as D
from citeframe.operators.features import page_features
from citeframe.operators.rules import audit_issues
from citeframe.session import stage
from citeframe.sources.site_files import parse_robots, read_pages, sites_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL it is checked against."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def joined(c: str, glue: str = "|"):
    """Array as text, for engine-neutral comparison."""
    return F.array_join(c, glue).alias(c)




# Staged inputs shared by several queries of one session.
_staged: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = stage(build(), name)
    return _staged[key]


def forget() -> None:
    """Drop the staged inputs, so that the next query builds its own (used for timing)."""
    _staged.clear()


def sites(spark, sf) -> DataFrame:
    return D.derived(spark, sf, D.SITES)


def brands(spark, sf) -> DataFrame:
    return D.brands_of(spark, sf, D.BRANDS)


def facts(spark, sf) -> DataFrame:
    return D.derived(spark, sf, D.FACTS)


def competitors(spark, sf) -> DataFrame:
    return D.derived(spark, sf, D.COMPETITORS)


def robots(spark, sf) -> DataFrame:
    return parse_robots(D.derived(spark, sf, D.ROBOTS))[0]


def features(spark, sf) -> DataFrame:
    """Features of the derived sites."""
    return shared(spark, sf, "features", lambda: page_features(D.site_pages(spark, sf), sites(spark, sf)))


def issues(spark, sf) -> DataFrame:
    return shared(
        spark, sf, "issues",
        lambda: audit_issues(features(spark, sf), sites(spark, sf), robots(spark, sf), brands(spark, sf), competitors(spark, sf)),
    )


def given_pages(spark, sf) -> DataFrame:
    """The given pages as they are; the site is the host."""
    return read_pages(spark, f"{sf}/pages.parquet")


def given_sites(spark, sf) -> DataFrame:
    return sites_of(given_pages(spark, sf))
