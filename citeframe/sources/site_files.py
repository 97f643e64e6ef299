"""Stored pages, robots files and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe import constants as C
from citeframe.functions import urls as U
from citeframe.session import stage
from citeframe.sources.sitemap_xml import sitemap_locations


def read_pages(spark: SparkSession, path: str, base_url: str | None = None, site_id: str | None = None) -> DataFrame:
    """Stored pages as ``pages_raw``.

    Without ``base_url`` the path is a Parquet table with url and html (plus any of site_id, status,
    content_type, fetch_error). With it the path is a folder of html files laid out like the site.
    """
    if base_url is None:
        return as_pages_raw(spark.read.parquet(path))
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").text(path, wholetext=True)
    root = path.rstrip("/") + "/"
    name = F.substring_index(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), root, -1)
    route = F.regexp_replace(F.regexp_replace(name, "(?i)index\\.html$", ""), "(?i)\\.html$", "")
    url = U.comparable_url(F.concat(F.lit(base_url.rstrip("/") + "/"), route))
    site = F.lit(site_id) if site_id else F.lit(None).cast("string")
    return as_pages_raw(files.select(site.alias("site_id"), url.alias("url"), F.col("value").alias("html")))


def as_pages_raw(pages: DataFrame) -> DataFrame:
    """Fill the columns a page table lacks; the site defaults to the host."""
    url = U.comparable_url(F.col("url"))
    have = set(pages.columns)
    site = F.coalesce("site_id", U.url_host(F.col("url"))) if "site_id" in have else U.url_host(F.col("url"))
    status = F.col("status").cast("int") if "status" in have else F.lit(200)
    kind = F.col("content_type") if "content_type" in have else F.lit("text/html")
    error = F.col("fetch_error") if "fetch_error" in have else F.lit(None).cast("string")
    if "status" in have and "fetch_error" not in have:
        error = F.when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string")))
    return pages.select(
        site.alias("site_id"), url.alias("url"), status.alias("status"), kind.alias("content_type"),
        error.alias("fetch_error"), "html",
    )


def sites_of(pages: DataFrame) -> DataFrame:
    """One row per site with the origin of its pages as base url."""
    return pages.groupBy("site_id").agg(F.min(U.url_origin(F.col("url"))).alias("base_url"))


def parse_robots(robots_raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Robots files as (one row per site, one row per rule).

    A disallow line belongs to the last user-agent line above it, ``*`` before the first one; agents
    are compared as written and only an exact ``/`` blocks. The walk over the lines happens inside
    the row, so nothing is shuffled.
    """
    lines = F.transform(F.split(F.col("text"), "\\r?\\n"), lambda l, i: F.struct(F.trim(l).alias("line"), (i + 1).alias("line_no")))
    parsed = F.transform(
        lines,
        lambda x: F.struct(
            x["line_no"].alias("line_no"),
            F.lower(F.trim(F.regexp_extract(x["line"], "^([^:]+):", 1))).alias("directive"),
            F.trim(F.regexp_extract(x["line"], "^[^:]+:(.*)$", 1)).alias("value"),
        ),
    )
    kept = F.filter(parsed, lambda x: (F.length(x["directive"]) > 0) & (F.length(x["value"]) > 0))
    rule = "struct<agent:string,directive:string,value:string,line_no:int>"
    start = F.struct(F.lit("*").alias("agent"), F.array().cast(f"array<{rule}>").alias("rules"))

    def step(acc, x):
        row = F.struct(acc["agent"].alias("agent"), x["directive"].alias("directive"), x["value"].alias("value"), x["line_no"].alias("line_no"))
        return (
            F.when(x["directive"] == "user-agent", F.struct(x["value"].alias("agent"), acc["rules"].alias("rules")))
            .when(x["directive"].isin("disallow", "sitemap"), F.struct(acc["agent"].alias("agent"), F.array_append(acc["rules"], row).alias("rules")))
            .otherwise(acc)
        )

    rules = F.aggregate(kept, start, step, lambda acc: acc["rules"])
    df = robots_raw.withColumn("rules", F.coalesce(rules, F.array().cast(f"array<{rule}>")))

    def blocked(agent: str):
        return F.exists("rules", lambda r: (r["directive"] == "disallow") & (r["agent"] == agent) & (r["value"] == "/"))

    bots = F.filter(F.array(*[F.when(blocked(b), F.lit(b)) for b in C.AI_BOTS]), lambda b: b.isNotNull())
    robots = df.select(
        "site_id",
        (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("exists"),
        blocked("*").alias("blocked_all"),
        bots.alias("blocked_bots"),
        F.transform(F.filter("rules", lambda r: r["directive"] == "sitemap"), lambda r: r["value"]).alias("sitemap_hints"),
    )
    return robots, df.select("site_id", F.explode("rules").alias("r")).select("site_id", "r.*")


def parse_sitemaps(sitemaps_raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locations of stored sitemaps as (page locations, nested sitemap locations).

    A file with url entries only counts those; otherwise it is read as an index. Locations ending in
    ``.xml`` name further sitemaps.
    """
    rows = sitemaps_raw.select("site_id", "sitemap_url", F.posexplode(sitemap_locations("xml")).alias("loc_ord", "loc"))
    nested = F.endswith("loc", F.lit(".xml"))
    return rows.filter(~nested), rows.filter(nested)


def reachable_sitemaps(sitemaps_raw: DataFrame, sites: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """Stored sitemaps reached from robots hints and the two well-known paths, following index files.

    Each hop joins the newly reached files with the index entries and is staged, until a hop finds
    nothing new; loops between index files end that way too.
    """
    from citeframe.operators.crawl import build_url

    stored = sitemaps_raw.withColumn("sitemap_url", U.comparable_url(F.col("sitemap_url")))
    hints = F.array(F.lit("/sitemap.xml"), F.lit("/sitemap_index.xml"))
    start = sites.select("site_id", "base_url", F.explode(hints).alias("hint"))
    if robots is not None:
        named = robots.select("site_id", F.explode("sitemap_hints").alias("hint")).join(sites.select("site_id", "base_url"), "site_id")
        start = start.unionByName(named)
    key = ["site_id", "sitemap_url"]
    start = start.select("site_id", build_url(F.col("hint"), F.col("base_url")).alias("sitemap_url"))
    _, nested = parse_sitemaps(stored)
    edges = stage(nested.select(*key, U.comparable_url(F.col("loc")).alias("child")).distinct(), "sitemap-edges")
    frontier = stage(start.distinct(), "sitemap-hop")
    seen = frontier
    while True:
        found = edges.join(frontier, key, "left_semi").select("site_id", F.col("child").alias("sitemap_url")).distinct()
        frontier = stage(found.join(seen, key, "left_anti"), "sitemap-hop")
        if frontier.isEmpty():
            return stored.join(seen, key, "left_semi")
        seen = seen.unionByName(frontier)
