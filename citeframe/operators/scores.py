"""Bucket scores, audit summary, recommendations and the top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeframe import constants as C
from citeframe.functions.numbers import clamp, half_up
from citeframe.operators.phrases import with_names
from citeframe.operators.rules import missing_page_types


def bucket_scores(issues: DataFrame, sites: DataFrame) -> DataFrame:
    """Score and issue counts per site and bucket; a bucket without issues scores 100.

    One aggregate row per site holds all five buckets and is unfolded afterwards, so empty buckets
    need no outer join with a bucket list.
    """
    bucket, severity = F.col("bucket"), F.col("severity")
    penalty = F.lit(0)
    for name, points in C.SEVERITY_PENALTY.items():
        penalty = F.when(severity == name, points).otherwise(penalty)
    aggs = []
    for b in C.BUCKETS:
        aggs.append(F.sum(F.when(bucket == b, penalty).otherwise(0)).alias(f"{b}_penalty"))
        aggs += [F.count_if((bucket == b) & (severity == s)).alias(f"{b}_{s}") for s in C.SEVERITY_PENALTY]
    wide = sites.select("site_id").join(issues.groupBy("site_id").agg(*aggs), "site_id", "left")

    def n(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long")

    rows = [
        F.struct(
            F.lit(b).alias("bucket"),
            clamp(100 - n(f"{b}_penalty"), 0, 100).cast("int").alias("score"),
            (n(f"{b}_error") + n(f"{b}_warn") + n(f"{b}_info")).alias("issue_count"),
            n(f"{b}_error").alias("error_count"),
            n(f"{b}_warn").alias("warn_count"),
            n(f"{b}_info").alias("info_count"),
        )
        for b in C.BUCKETS
    ]
    return wide.select("site_id", F.explode(F.array(*rows)).alias("r")).select("site_id", "r.*")


def overall_score(scores: DataFrame) -> DataFrame:
    """Mean of the five bucket scores, halves upwards."""
    return scores.groupBy("site_id").agg(half_up(F.avg("score")).cast("int").alias("overall_score"))


def audit_summary(sites: DataFrame, pages: DataFrame, scores: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Score, missing types and page counts per site; ``vavr`` stays NULL until answers are attached."""
    missing = missing_page_types(pages, sites).groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.struct("type_ord", "page_type"))).alias("_m")
    )
    counts = pages.groupBy("site_id").agg(
        F.count("*").alias("crawled_pages"), F.count_if(F.col("page_type") != "other").alias("key_page_count")
    )
    out = sites.select("site_id").join(overall_score(scores), "site_id", "left").join(counts, "site_id", "left")
    out = out.join(missing, "site_id", "left")
    if discovered is not None:
        found = discovered.groupBy("site_id").agg(F.count("*").alias("discovered_urls"))
        out = out.join(found, "site_id", "left")
    else:
        out = out.withColumn("discovered_urls", F.col("crawled_pages"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("crawled_pages", "key_page_count", "discovered_urls")}
    return out.withColumns(zero).select(
        "site_id", "overall_score", F.lit(None).cast("int").alias("vavr"),
        F.coalesce(F.col("_m.page_type"), F.array().cast("array<string>")).alias("missing_page_types"),
        "crawled_pages", "discovered_urls", "key_page_count",
    )


# fixed values: id, title and source bucket of each recommendation. Rationale and outcome are free text.
_ADVICE = [
    ("remove-crawl-blockers", "Remove crawl and indexing blockers", "access",
     "Answers start from pages that may be crawled and read.", "Pages are found and read more reliably."),
    ("tighten-page-structure", "Tighten structure and schema alignment on key pages", "structure",
     "Thin or contradictory pages are read in different ways.", "Page content is extracted more consistently."),
    ("clarify-homepage-positioning", "Clarify homepage positioning", "entityClarity",
     "Category, audience and use cases must be stated to be repeated.", "The product is described correctly."),
    ("add-citable-evidence", "Add citable pricing, trust, and documentation proof", "evidence",
     "Grounded answers cite prices, controls, documents and outcomes.", "More pages can be cited as evidence."),
    ("close-comparison-gaps", "Close FAQ, compare, integrations, and use-case gaps", "comparativeReadiness",
     "Comparisons need dedicated pages and links that explain them.", "Comparison prompts find usable sources."),
]


def recommendations(issues: DataFrame, missing: DataFrame, sites: DataFrame) -> DataFrame:
    """Recommendations whose bucket has issues, or whose page types are missing, with the issue count."""
    has = issues.groupBy("site_id").agg(*[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in C.BUCKETS])
    gaps = missing.groupBy("site_id").agg(
        F.count("*").alias("n_missing"),
        F.count_if(F.col("page_type").isin("pricing", "security")).alias("n_proof_missing"),
    )
    df = sites.select("site_id").join(has, "site_id", "left").join(gaps, "site_id", "left").na.fill(0)
    rows = []
    for i, (rec_id, title, bucket, rationale, outcome) in enumerate(_ADVICE, start=1):
        n = F.col(f"n_{bucket}")
        due = n > 0
        if bucket == "evidence":
            due = due | (F.col("n_proof_missing") > 0)
        if bucket == "comparativeReadiness":
            due = due | (F.col("n_missing") > 0)
        rows.append(
            F.when(
                due,
                F.struct(
                    F.lit(i).alias("rec_ord"), F.lit(rec_id).alias("rec_id"), F.lit(title).alias("title"),
                    F.lit(bucket).alias("bucket"), F.lit(rationale).alias("rationale"),
                    F.lit(outcome).alias("expected_outcome"), n.alias("issue_count"),
                ),
            )
        )
    kept = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return df.select("site_id", F.explode(kept).alias("r")).select("site_id", "r.*")


def recommendation_issues(issues: DataFrame) -> DataFrame:
    """Related issues of each recommendation as a long table ordered by ``issue_seq``.

    A site can have millions of issues, so they are rows and not one array.
    """
    rec = F.lit(None).cast("string")
    for rec_id, _, bucket, _, _ in _ADVICE:
        rec = F.when(F.col("bucket") == bucket, F.lit(rec_id)).otherwise(rec)
    return issues.select("site_id", rec.alias("rec_id"), "issue_seq", "issue_id")


def first_per_site(df: DataFrame, order: list, k: int, name: str) -> DataFrame:
    """First ``k`` rows per site; the window limit trims every map task before the shuffle."""
    w = Window.partitionBy("site_id").orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def top_issues(issues: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` distinct (title, fix hint) of each site in issue order."""
    kinds = issues.groupBy("site_id", "title", "fix_hint").agg(
        F.min_by(F.struct("severity", F.coalesce("page_url", F.lit("site")).alias("scope")), "issue_seq").alias("f"),
        F.min("issue_seq").alias("issue_seq"),
    )
    top = first_per_site(kinds, ["issue_seq"], k, "top_ord")
    return top.select("site_id", "top_ord", "f.severity", "title", "f.scope", "fix_hint")


def head_issues(issues: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` issues of each site."""
    return first_per_site(issues, ["issue_seq"], k, "issue_ord")


def top_recommendations(recs: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` recommendations of each site."""
    return first_per_site(recs, ["rec_ord"], k, "top_ord")


def competitor_coverage(pages: DataFrame, competitors: DataFrame) -> DataFrame:
    """Per declared competitor: named on compare pages?, how many of them, the first one.

    Pages meet the names by an index of pieces; only actual mentions become rows.
    """
    def normal(c):
        return F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))

    compare = pages.filter(F.col("page_type") == "compare").select(
        "site_id", "url", "page_rank", F.concat_ws(" ", "title", "h1", "text_snippet").alias("_text")
    )
    names = competitors.select("site_id", F.col("comp_ord").alias("ord"), "name", normal("name").alias("needle"))
    hits = with_names(compare, names, normal("_text"), "_found")
    hits = hits.select("site_id", "url", "page_rank", F.explode(F.array_distinct(F.transform("_found", lambda x: x["name"]))).alias("name"))
    found = hits.groupBy("site_id", "name").agg(
        F.count("*").alias("n_pages"), F.min_by("url", F.struct("page_rank", "url")).alias("first_page")
    )
    out = competitors.select("site_id", "comp_ord", "name").join(found, ["site_id", "name"], "left")
    return out.select(
        "site_id", "comp_ord", "name", F.col("n_pages").isNotNull().alias("named"),
        F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"), "first_page",
    )


def competitor_gaps(coverage: DataFrame) -> DataFrame:
    """Competitors that no compare page names."""
    return coverage.filter(~F.col("named")).select("site_id", "comp_ord", "name")
