"""Crawl-plan tables over stored robots files, sitemaps and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeframe import constants as C
from citeframe.functions import text as T
from citeframe.functions import urls as U
from citeframe.operators.features import crawl_rank
from citeframe.operators.ranks import ranked


def _inside(url: Column, base: Column) -> Column:
    """Same origin, and below the base path."""
    folder = F.concat(F.regexp_replace(U.url_path(base), "/+$", ""), F.lit("/"))
    path = U.url_path(url)
    same = U.url_origin(U.comparable_url(url)) == U.url_origin(U.comparable_url(base))
    return same & (F.startswith(path, folder) | (F.concat(path, F.lit("/")) == folder))


def in_scope(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Urls on the site's origin and below its base path."""
    df = urls.join(sites.select("site_id", "base_url"), "site_id")
    return df.filter(_inside(F.col("url"), F.col("base_url"))).drop("base_url")


def filter_patterns(urls: DataFrame, include=(), exclude=()) -> DataFrame:
    """Include and exclude globs on the url or its path; exclude wins, no include keeps everything."""
    url = F.col("url")
    path = U.url_path(url)
    keep = F.lit(True)
    if include:
        keep = T.glob_match(url, include) | T.glob_match(path, include)
    if exclude:
        keep = keep & ~(T.glob_match(url, exclude) | T.glob_match(path, exclude))
    return urls.filter(keep)


def build_url(target: Column, base: Column) -> Column:
    """Comparable url of an absolute target, or of a path below the base url."""
    root = F.regexp_replace(base, "/$", "")
    joined = F.when(F.startswith(target, F.lit("/")), F.concat(root, target)).otherwise(F.concat(root, F.lit("/"), target))
    return U.comparable_url(F.when(target.rlike("(?i)^https?://"), target).otherwise(joined))


def discover_urls(locs: DataFrame, sites: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Distinct urls per site: sitemap locations; a site without any falls back to its stored pages, else its base url."""
    listed = locs.filter(~F.endswith("loc", F.lit(".xml"))).join(sites.select("site_id", "base_url"), "site_id")
    listed = listed.select("site_id", build_url(F.col("loc"), F.col("base_url")).alias("url"))
    bare = sites.select("site_id", "base_url").join(listed.select("site_id").distinct(), "site_id", "left_anti")
    if pages is None:
        rest = bare.select("site_id", U.comparable_url(F.col("base_url")).alias("url"))
    else:
        stored = pages.select("site_id", U.comparable_url(F.col("url")).alias("url"))
        rest = stored.join(bare.select("site_id"), "site_id", "left_semi")
        empty = bare.join(pages.select("site_id").distinct(), "site_id", "left_anti")
        rest = rest.unionByName(empty.select("site_id", U.comparable_url(F.col("base_url")).alias("url")))
    return listed.unionByName(rest).dropDuplicates(["site_id", "url"])


def plan_targets(urls: DataFrame, max_pages: int | None = None, include=(), exclude=()) -> DataFrame:
    """Urls per site in order of crawl rank, then url; only the first ``max_pages`` where a limit is given.

    A limit trims each map task first; without one all urls are ranked by ranges, however large a site is.
    """
    known = filter_patterns(urls, include, exclude).withColumn("crawl_rank", crawl_rank(F.col("url")))
    if max_pages is None:
        return ranked(known, ["site_id"], [F.col("crawl_rank"), F.col("url")], "target_ord")
    w = Window.partitionBy("site_id").orderBy("crawl_rank", "url")
    return known.withColumn("target_ord", F.row_number().over(w)).filter(F.col("target_ord") <= max_pages)


def refresh_target(page_url: Column, refresh: Column) -> Column:
    """Target of a ``refresh`` meta value."""
    href = F.regexp_extract(refresh, "(?i)(?:^|;)\\s*url\\s*=\\s*([^;]+)", 1)
    href = F.regexp_replace(F.trim(href), "^['\"]|['\"]$", "")
    return U.absolute_url(page_url, href)


def admitted(pages: DataFrame) -> DataFrame:
    """Pages of html or plain text, and failed fetches (status 0 or none); other content is no page to audit."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return pages.filter(F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text/plain")) | (F.coalesce("status", F.lit(0)) == 0))


def resolve_redirects(pages: DataFrame, sites: DataFrame, include=(), exclude=(), stored: DataFrame | None = None) -> DataFrame:
    """Pages that only refresh to another page of the site are replaced by that page, one hop.

    ``pages`` carries the stored row plus ``refresh`` (the refresh meta value). Targets are looked up in
    ``stored``, by default ``pages`` itself, so a target need not be planned. The result keeps one row per url,
    the one that comes first in crawl order; a target that is not stored is a 404 row. Pages and targets that
    are not ``admitted`` are left out.
    """
    stored = pages if stored is None else stored
    pages = admitted(pages)
    df = pages.join(sites.select("site_id", "base_url"), "site_id")
    target = refresh_target(F.col("url"), F.col("refresh"))
    html = F.contains("content_type", F.lit("html")) & F.col("status").between(200, 299)
    df = df.withColumn("_target", F.when(html, target))
    df = df.withColumn(
        "_target", F.when((F.col("_target") != F.col("url")) & _inside(F.col("_target"), F.col("base_url")), F.col("_target"))
    )
    if include or exclude:
        wanted = filter_patterns(df.select("site_id", F.col("_target").alias("url")).filter("url IS NOT NULL"), include, exclude)
        wanted = wanted.distinct().withColumnRenamed("url", "_target").withColumn("_ok", F.lit(True))
        df = df.join(wanted, ["site_id", "_target"], "left")
        df = df.withColumn("_target", F.when(F.col("_ok"), F.col("_target"))).drop("_ok")
    df = df.withColumn("_rank", crawl_rank(F.col("url")))
    kept = [c for c in pages.columns if c not in ("site_id", "url", "refresh")]
    direct = df.filter("_target IS NULL").select("site_id", "url", *kept, "_rank", F.col("url").alias("_from"))
    moved = df.filter("_target IS NOT NULL").select("site_id", F.col("_target").alias("url"), "_rank", F.col("url").alias("_from"))
    # several shims may share a target; only the first keeps its place
    moved = moved.groupBy("site_id", "url").agg(F.min(F.struct("_rank", "_from")).alias("f"))
    moved = moved.select("site_id", "url", "f.*").join(stored.select("site_id", "url", *kept), ["site_id", "url"], "left")
    moved = moved.withColumns(
        {
            "fetch_error": F.when(
                F.col("status").isNull(), F.concat(F.lit("No stored page for "), U.url_path(F.col("url")))
            ).otherwise(F.col("fetch_error")),
            "content_type": F.coalesce("content_type", F.lit("text/plain")),
            "status": F.coalesce("status", F.lit(404)),
        }
    )
    every = direct.unionByName(admitted(moved).select(*direct.columns))
    first = every.groupBy("site_id", "url").agg(F.min_by(F.struct(*kept, "_rank"), F.struct("_rank", "_from")).alias("p"))
    return first.select("site_id", "url", "p.*").withColumnRenamed("_rank", "crawl_rank")


def key_pages(pages: DataFrame, proof_only: bool = False) -> DataFrame:
    """Pages of the key types, or of the key proof types only."""
    return pages.filter(F.col("page_type").isin(C.KEY_PROOF_PAGE_TYPES if proof_only else C.KEY_PAGE_TYPES))
