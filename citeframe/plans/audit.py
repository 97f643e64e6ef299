"""Site audit: stored files to issues, scores and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.functions import urls as U
from citeframe.operators import crawl, scores
from citeframe.operators.bloom import bloom_of
from citeframe.operators.extract import extract_pages, scan_page
from citeframe.operators.features import crawl_rank, features_of
from citeframe.operators.joins import lookup_join
from citeframe.operators.rule_catalog import RuleBook
from citeframe.operators.rules import audit_issues, missing_page_types
from citeframe.schemas import schema
from citeframe.session import stage
from citeframe.sources.site_files import parse_robots, parse_sitemaps, reachable_sitemaps

_NARROW = ["site_id", "url", "status", "content_type", "fetch_error", "refresh", "part_id"]


def discovered_urls(stored: DataFrame, sites: DataFrame, robots: DataFrame | None = None, sitemaps_raw: DataFrame | None = None) -> DataFrame:
    """Urls of each site: sitemap locations where there are some, else its stored pages, else its base url."""
    if sitemaps_raw is None:
        return stored.select("site_id", "url").distinct()
    locs, _ = parse_sitemaps(reachable_sitemaps(sitemaps_raw, sites, robots))
    return crawl.discover_urls(locs, sites, stored)


def crawl_plan(pages_raw: DataFrame, sites: DataFrame, robots_raw: DataFrame | None = None,
               sitemaps_raw: DataFrame | None = None, max_pages: int | None = None, include=(), exclude=()) -> DataFrame:
    """Urls of each site that the audit covers, in crawl order."""
    robots = parse_robots(robots_raw)[0] if robots_raw is not None else None
    found = discovered_urls(pages_raw.select("site_id", "url"), sites, robots, sitemaps_raw)
    return crawl.plan_targets(found, max_pages, include, exclude)


def page_parts(pages_raw: DataFrame) -> DataFrame:
    """The one parse of an audit: parts of every stored page with a row locator ``part_id``; the html ends here."""
    return stage(extract_pages(pages_raw).withColumn("part_id", F.monotonically_increasing_id()), "page-parts")


def planned_rows(parts: DataFrame, targets: DataFrame, sites: DataFrame, include=(), exclude=(), absent: bool = True) -> DataFrame:
    """The audited rows, narrow: stored pages of the planned urls, shims resolved, each with its ``part_id``.

    A planned url without a stored page is a failed fetch (404, no ``part_id``) unless ``absent`` is false.
    """
    narrow = parts.select(*_NARROW)
    known = targets.select("site_id", "url").join(narrow, ["site_id", "url"], "left" if absent else "inner")
    lost = F.col("part_id").isNull()
    known = known.withColumns({
        "fetch_error": F.when(lost, F.concat(F.lit("No stored page for "), U.url_path(F.col("url")))).otherwise(F.col("fetch_error")),
        "content_type": F.when(lost, F.lit("text/plain")).otherwise(F.col("content_type")),
        "status": F.when(lost, F.lit(404)).otherwise(F.col("status")),
    })
    resolved = crawl.resolve_redirects(known.select(*_NARROW), sites, include, exclude, stored=narrow)
    return stage(resolved, "audit-plan")


def audited_parts(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """Parts of the audited rows with ``crawl_rank``: wide rows meet the narrow plan by their locator.

    When most pages stay, only the locators left out and the ranks that differ from the url's own are looked up,
    two short lists that Spark broadcasts up to its size limit, so that wide rows are not shuffled. When most go, a
    Bloom filter of the locators kept drops the others before the join.
    """
    kept = plan.where("part_id is not null").select("part_id", "url", "crawl_rank")
    stays, total = kept.count(), parts.count()
    if 2 * stays >= total:
        out = stage(parts.select("part_id").join(kept.select("part_id"), "part_id", "left_anti"), "audit-left-out")
        ranks = stage(kept.where(F.col("crawl_rank") != crawl_rank(F.col("url"))).select("part_id", F.col("crawl_rank").alias("_rank")), "audit-ranks")
        rows = lookup_join(lookup_join(parts, out, ["part_id"], "left_anti"), ranks, ["part_id"], "left")
        rows = rows.withColumn("crawl_rank", F.coalesce("_rank", crawl_rank(F.col("url")))).drop("_rank")
    else:
        may = bloom_of(kept, ["part_id"], stays).may_hold("part_id")
        rows = lookup_join(parts.where(may), kept.select("part_id", "crawl_rank"), ["part_id"])
    return rows.unionByName(_without_page(plan.where("part_id is null"), parts), allowMissingColumns=True).drop("part_id")


def _without_page(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Failed fetches with the parts of an empty page."""
    empty = scan_page(None)
    columns = ["site_id", "url", "status", "content_type", "fetch_error", "crawl_rank", "part_id"]
    for field in schema("page_parts").fields:
        value = empty[field.name]
        column = F.array() if isinstance(field.dataType, T.ArrayType) else F.lit(value)
        columns.append(column.cast(parts.schema[field.name].dataType).alias(field.name))
    return rows.select(*columns)


def fetched_pages(pages_raw: DataFrame, targets: DataFrame, sites: DataFrame, include=(), exclude=()) -> DataFrame:
    """Stored pages of the planned urls with redirect shims resolved, as parts; targets without a page are left out."""
    parts = page_parts(pages_raw)
    return audited_parts(parts, planned_rows(parts, targets, sites, include, exclude, absent=False))


def run_audit(pages_raw: DataFrame, sites: DataFrame, robots_raw: DataFrame | None = None, brands: DataFrame | None = None,
              competitors: DataFrame | None = None, sitemaps_raw: DataFrame | None = None, max_pages: int | None = None,
              include=(), exclude=(), book: RuleBook | None = None) -> dict[str, DataFrame]:
    """All audit tables, from stored files on.

    Every page is parsed once, in place. Discovery, crawl order, limits and redirects run on narrow rows; parts meet
    the plan by a row locator. Features and issues are staged, so page rules, site rules, link rules and summaries
    each read only the columns they need.
    """
    parts = page_parts(pages_raw)
    robots = parse_robots(robots_raw)[0] if robots_raw is not None else None
    found = discovered_urls(parts.select("site_id", "url"), sites, robots, sitemaps_raw)
    targets = stage(crawl.plan_targets(found, max_pages, include, exclude), "audit-targets")
    plan = planned_rows(parts, targets, sites, include, exclude)
    pages = stage(features_of(audited_parts(parts, plan), sites), "features")
    issues = stage(audit_issues(pages, sites, robots, brands, competitors, targets, book), "issues")
    buckets = scores.bucket_scores(issues, sites)
    missing = missing_page_types(pages, sites)
    recs = scores.recommendations(issues, missing, sites)
    return {
        "targets": targets,
        "pages": pages,
        "issues": issues,
        "bucket_scores": buckets,
        "audit_summary": scores.audit_summary(sites, pages, buckets, targets),
        "recommendations": recs,
        "recommendation_issues": scores.recommendation_issues(issues),
        "top_issues": scores.top_issues(issues),
        "top_recommendations": scores.top_recommendations(recs),
    }
