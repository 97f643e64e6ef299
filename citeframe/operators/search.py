"""Search-performance rows joined to the audited pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe import constants as C
from citeframe.functions import text as T
from citeframe.functions import urls as U
from citeframe.operators.crawl import key_pages
from citeframe.operators.ranks import ranked
from citeframe.operators.scores import first_per_site

KEY = ["site_id", "source", "search_key"]


def aggregate_search(rows: DataFrame) -> DataFrame:
    """One row per search url: summed counts, impression-weighted ctr and position, last raw page string.

    A row without impressions weighs 1. The first step groups by raw page as well and keeps numbers
    only, so it is a hash aggregation that combines before the shuffle and deals a busy url out over
    its spellings; the second step sees one row per spelling.
    """
    weight = F.when(F.col("impressions") > 0, F.col("impressions")).otherwise(F.lit(1.0))
    per_page = rows.groupBy("site_id", "source", "page").agg(
        F.max("row_no").alias("row_no"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum(F.col("ctr") * weight).alias("ctr"),
        F.sum(F.col("position") * weight).alias("position"),
        F.sum(weight).alias("weight"),
    )
    df = per_page.withColumn("search_key", U.search_url(F.col("page")))
    return df.groupBy(*KEY).agg(
        F.max_by("page", "row_no").alias("page"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        (F.sum("ctr") / F.sum("weight")).alias("ctr"),
        (F.sum("position") / F.sum("weight")).alias("position"),
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for name, n in C.SEVERITY_RANK.items():
        rank = F.when(severity == name, n).otherwise(rank)
    return rank


def issues_by_search_key(issues: DataFrame) -> DataFrame:
    """Issues per page in search form: count, highest severity, first titles, ids.

    The list per page is bounded by the number of rules, not by the data.
    """
    df = issues.filter(F.col("page_url").isNotNull()).withColumn("search_key", U.search_url(F.col("page_url")))
    grouped = df.groupBy("site_id", "search_key").agg(
        F.count("*").alias("audit_issue_count"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("highest_severity"),
        F.array_sort(F.collect_list(F.struct("issue_seq", "title", "issue_id"))).alias("_i"),
    )
    return grouped.select(
        "site_id", "search_key", "audit_issue_count", "highest_severity",
        F.slice(F.col("_i.title"), 1, 3).alias("first_titles"), F.col("_i.issue_id").alias("issue_ids"),
    )


def match_search_pages(search: DataFrame, pages: DataFrame, issues: DataFrame, sites: DataFrame) -> DataFrame:
    """Aggregated search rows with scope, matched page and issue figures.

    Both sides are keyed by (site, search url) and unique on it, so there is nothing to skew.
    """
    domains = sites.select("site_id", U.url_domain(F.col("base_url")).alias("_site_domain"))
    audited = pages.select("site_id", U.search_url(F.col("url")).alias("search_key"), "url", "page_type", "page_rank")
    # several stored urls may share one search form; the last in page order represents it
    audited = audited.groupBy("site_id", "search_key").agg(
        F.max_by(F.struct("url", "page_type"), F.struct("page_rank", "url")).alias("a")
    )
    df = search.join(domains, "site_id", "left").withColumn("domain", U.url_domain(F.col("search_key")))
    df = df.withColumn("out_of_scope", ~F.coalesce(U.domain_in(F.col("domain"), F.col("_site_domain")), F.lit(False)))
    df = df.join(audited, ["site_id", "search_key"], "left").join(issues_by_search_key(issues), ["site_id", "search_key"], "left")
    hit = ~F.col("out_of_scope") & F.col("a").isNotNull()
    return df.select(
        *KEY, "page", "domain", "clicks", "impressions", "ctr", "position", "out_of_scope",
        F.when(hit, F.col("a.url")).alias("matched_url"),
        F.when(hit, F.col("a.page_type")).alias("matched_page_type"),
        (F.col("impressions") > 0).alias("has_evidence"),
        (F.col("clicks") > 0).alias("has_clicks"),
        F.when(hit, F.coalesce("audit_issue_count", F.lit(0))).otherwise(0).cast("long").alias("audit_issue_count"),
        F.when(hit, F.col("highest_severity")).alias("highest_severity"),
        F.when(hit, F.col("first_titles")).alias("first_titles"),
        F.when(hit, F.col("issue_ids")).alias("issue_ids"),
    )


def _label(source: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in C.SEARCH_SOURCE_LABEL.items():
        label = F.when(source == name, F.lit(text)).otherwise(label)
    return label


def key_page_coverage(pages: DataFrame, search_pages: DataFrame, source: str) -> DataFrame:
    """Evidence flag, impressions and clicks of each key proof page."""
    hits = search_pages.filter((F.col("source") == source) & ~F.col("out_of_scope") & F.col("matched_url").isNotNull())
    hits = hits.groupBy("site_id", F.col("matched_url").alias("url")).agg(
        F.bool_or("has_evidence").alias("has_evidence"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
    )
    df = key_pages(pages, proof_only=True).select("site_id", "url", "page_type").join(hits, ["site_id", "url"], "left")
    return df.select(
        "site_id", F.lit(source).alias("source"), F.col("url").alias("page_url"), "page_type",
        F.coalesce("has_evidence", F.lit(False)).alias("has_evidence"),
        F.coalesce("impressions", F.lit(0.0)).alias("impressions"), F.coalesce("clicks", F.lit(0.0)).alias("clicks"),
    )


def sort_coverage(coverage: DataFrame) -> DataFrame:
    """Coverage by impressions, largest first, then url; ``coverage_ord`` is the place within site and source."""
    placed = ranked(coverage, ["site_id", "source"], [F.desc("impressions"), F.col("page_url")], "coverage_ord")
    return placed.orderBy("site_id", "source", "coverage_ord")


def no_evidence_findings(coverage: DataFrame) -> DataFrame:
    """Key proof pages without any search evidence."""
    severity = F.lit("info")
    for page_type, level in C.NO_EVIDENCE_SEVERITY.items():
        severity = F.when(F.col("page_type") == page_type, F.lit(level)).otherwise(severity)
    label = _label(F.col("source"))
    return coverage.filter(~F.col("has_evidence")).select(
        "site_id", "source",
        F.concat("source", F.lit("-no-evidence-"), "page_type", F.lit("-"), T.slug(F.col("page_url"))).alias("finding_id"),
        severity.alias("severity"),
        F.concat(F.lit("Key page has no "), label, F.lit(" evidence")).alias("title"),
        "page_url", "page_type",
        F.concat(F.lit("Expected evidence on "), "page_url").alias("evidence"),
        F.array().cast("array<string>").alias("related_issue_ids"),
    )


def _visible(search_pages: DataFrame) -> DataFrame:
    return search_pages.filter(~F.col("out_of_scope") & F.col("has_evidence"))


def _count_text(x: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def not_crawled_findings(search_pages: DataFrame) -> DataFrame:
    """Search-visible pages that the crawl does not cover."""
    label = _label(F.col("source"))
    return _visible(search_pages).filter("matched_url IS NULL").select(
        "site_id", "source",
        F.concat("source", F.lit("-not-crawled-"), T.slug(F.col("page"))).alias("finding_id"),
        F.lit("warn").alias("severity"),
        F.concat(label, F.lit(" page is not covered by crawl")).alias("title"),
        F.col("page").alias("page_url"), F.lit(None).cast("string").alias("page_type"),
        F.concat(
            _count_text(F.col("impressions")), F.lit(" impressions, "), _count_text(F.col("clicks")), F.lit(" clicks")
        ).alias("evidence"),
        F.array().cast("array<string>").alias("related_issue_ids"),
    )


def blocker_findings(search_pages: DataFrame) -> DataFrame:
    """Search-visible pages that still have audit issues."""
    label = _label(F.col("source"))
    return _visible(search_pages).filter("matched_url IS NOT NULL AND audit_issue_count > 0").select(
        "site_id", "source",
        F.concat("source", F.lit("-audit-blockers-"), T.slug(F.col("page"))).alias("finding_id"),
        F.col("highest_severity").alias("severity"),
        F.concat(label, F.lit("-visible page still has audit blockers")).alias("title"),
        F.col("matched_url").alias("page_url"), F.col("matched_page_type").alias("page_type"),
        F.array_join("first_titles", "; ").alias("evidence"),
        F.col("issue_ids").alias("related_issue_ids"),
    )


def search_summary(search_pages: DataFrame, coverage: DataFrame) -> DataFrame:
    """Nine totals per site and source."""
    inside = ~F.col("out_of_scope")
    totals = search_pages.groupBy("site_id", "source").agg(
        F.count("*").alias("imported_page_count"),
        F.count_if(inside & F.col("matched_url").isNotNull()).alias("matched_page_count"),
        F.count_if("out_of_scope").alias("out_of_scope_page_count"),
        F.count_if(inside & F.col("has_clicks")).alias("pages_with_clicks"),
        F.count_if(inside & F.col("has_evidence")).alias("pages_with_impressions"),
        F.sum(F.when(inside, F.col("clicks")).otherwise(0.0)).alias("total_clicks"),
        F.sum(F.when(inside, F.col("impressions")).otherwise(0.0)).alias("total_impressions"),
    )
    keys = coverage.groupBy("site_id", "source").agg(
        F.count_if("has_evidence").alias("key_pages_with_evidence"),
        F.count_if(~F.col("has_evidence")).alias("key_pages_without_evidence"),
    )
    out = totals.join(keys, ["site_id", "source"], "left")
    return out.na.fill(0, ["key_pages_with_evidence", "key_pages_without_evidence"])


def top_search_pages(search_pages: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` in-scope pages per site by impressions, clicks, page."""
    inside = search_pages.filter(~F.col("out_of_scope"))
    return first_per_site(inside, [F.desc("impressions"), F.desc("clicks"), "page"], k, "top_ord")


def index_candidates(pages: DataFrame) -> DataFrame:
    """Fetched key pages worth submitting to an index, with the reason."""
    good = F.col("fetch_error").isNull() & F.col("status").between(200, 399) & (F.col("page_type") != "other")
    entry = F.col("page_type").isin("home", "product")
    reason = F.when(entry, "Entry point that should stay easy to find.").otherwise("Proof page that gains from a quick refresh.")
    return pages.filter(good).select("site_id", "url", "page_type", (~entry).alias("is_key_candidate"), reason.alias("reason"))


def index_candidate_counts(candidates: DataFrame) -> DataFrame:
    """Candidate totals per site."""
    return candidates.groupBy("site_id").agg(
        F.count("*").alias("candidate_count"), F.count_if("is_key_candidate").alias("key_page_candidate_count")
    )
