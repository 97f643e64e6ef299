"""Links: the per-page link records and the joins over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.functions import text as T
from citeframe.functions import urls as U
from citeframe.operators.joins import lookup_join


def _anchor(link: Column) -> Column:
    """Link text, else aria label, else title, else the last path segment."""
    text = T.squash(link["text"])
    shown = T.let(text, lambda t: F.when(F.length(t) > 0, T.truncate(t, 120)))
    return F.coalesce(
        shown,
        T.clean_text(link["aria"], 120),
        T.clean_text(link["title"], 120),
        T.truncate(U.last_segment_text(link["dst"]), 120),
    )


def _context(link: Column) -> Column:
    """Heading plus block text when that says at least 32 characters, else heading plus anchor."""
    heading, anchor = link["heading"], link["anchor"]
    block = link["block"]
    led = T.truncate(F.trim(F.concat_ws(" ", heading, block)), 180)
    covered = F.contains(F.lower(block), F.lower(heading))
    around = F.when(block.isNotNull(), F.when(covered, block).otherwise(led))
    whole = T.clean_text(F.concat_ws(" ", heading, around), 200)
    short = F.coalesce(T.clean_text(F.concat(heading, F.lit(" "), anchor), 160), T.truncate(anchor, 120))
    return T.let(whole, lambda w: F.when(F.length(w) >= 32, w).otherwise(short))


def with_links(pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Adds ``links``: resolved, deduplicated records of a page in document order.

    Internal links keep the first of each (target, anchor, context), external ones the first of
    each target. All of it happens inside the row, so nothing is shuffled. ``sites`` only matters
    where a site's own host differs from the page's.
    """
    df = pages
    if "base_url" not in df.columns:
        df = df.withColumn("base_url", F.lit(None).cast("string")) if sites is None else df.join(
            sites.select("site_id", "base_url"), "site_id", "left"
        )
    host = F.regexp_replace(U.url_origin(F.coalesce("base_url", "url")), "^[a-z]+://", "")
    df = df.withColumn("_host", host)
    resolved = F.transform(
        "raw_links",
        lambda x, i: F.struct(
            i.alias("link_ord"),
            U.absolute_url(F.col("url"), x["href"]).alias("dst"),
            x["text"].alias("text"),
            x["aria"].alias("aria"),
            x["title"].alias("title"),
            T.clean_text(x["block"], 180).alias("block"),
            T.clean_text(x["heading"], 120).alias("heading"),
        ),
    )
    df = df.withColumn("_resolved", F.filter(resolved, lambda x: x["dst"].isNotNull()))
    anchored = F.transform(
        "_resolved",
        lambda x: F.struct(
            x["link_ord"].alias("link_ord"),
            x["dst"].alias("dst"),
            (F.regexp_replace(U.url_origin(x["dst"]), "^[a-z]+://", "") == F.col("_host")).alias("is_internal"),
            _anchor(x).alias("anchor"),
            x["block"].alias("block"),
            x["heading"].alias("heading"),
        ),
    )
    df = df.withColumn("_anchored", anchored)
    keyed = F.transform(
        "_anchored",
        lambda x: T.let(
            F.when(x["is_internal"], _context(x)),
            lambda context: F.struct(
                F.when(x["is_internal"], F.concat_ws("\x00", x["dst"], F.lower(x["anchor"]), F.lower(context)))
                .otherwise(x["dst"])
                .alias("key"),
                x["link_ord"].alias("link_ord"),
                x["dst"].alias("dst_url"),
                F.when(x["is_internal"], x["anchor"]).alias("anchor_text"),
                context.alias("source_context"),
                x["is_internal"].alias("is_internal"),
            ),
        ),
    )
    # sort by key and position, keep the head of each run, restore document order
    df = df.withColumn("_keyed", F.array_sort(keyed))
    heads = F.filter(
        "_keyed", lambda x, i: (i == 0) | (F.get(F.col("_keyed"), i - 1)["key"] != x["key"])
    )
    links = F.array_sort(
        F.transform(
            heads,
            lambda x: F.struct(
                *[x[f].alias(f) for f in ("link_ord", "dst_url", "anchor_text", "source_context", "is_internal")]
            ),
        )
    )
    return df.withColumn("links", links).drop("_host", "_resolved", "_anchored", "_keyed", "raw_links")


def explode_links(pages: DataFrame) -> DataFrame:
    """Long link table (site_id, src_url, link_ord, dst_url, anchor_text, source_context, is_internal)."""
    source = pages if "links" in pages.columns else with_links(pages)
    return source.select("site_id", F.col("url").alias("src_url"), F.explode("links").alias("l")).select(
        "site_id", "src_url", "l.*"
    )


def incoming_links(pages: DataFrame) -> DataFrame:
    """Links into known pages from other pages, with the source's type and the target's attributes.

    Links meet the narrow page list on (site, target); targets that receive a large share of all links are
    found beforehand and joined apart.
    """
    links = pages.select("site_id", F.col("url").alias("src_url"), F.col("page_type").alias("src_page_type"),
                         "page_rank", F.explode("links").alias("l"))
    links = links.select("site_id", "src_url", "src_page_type", F.col("page_rank").alias("src_rank"), "l.*")
    links = links.filter("is_internal AND dst_url <> src_url")
    targets = pages.select("site_id", F.col("url").alias("dst_url"), F.col("page_type").alias("dst_page_type"))
    return lookup_join(links, targets.dropDuplicates(["site_id", "dst_url"]), ["site_id", "dst_url"], measured=True)


def first_home(pages: DataFrame) -> DataFrame:
    """First home page of each site in page order."""
    homes = pages.filter(F.col("page_type") == "home")
    keep = F.struct("url", "page_text", "links")
    best = homes.groupBy("site_id").agg(F.min_by(keep, F.struct("page_rank", "url")).alias("h"))
    return best.select("site_id", "h.*")


def homepage_linked_types(pages: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """Distinct page types other than home that the first home page links to."""
    homes = first_home(pages) if homes is None else homes
    out = homes.select("site_id", F.explode("links").alias("l")).filter("l.is_internal")
    out = out.select("site_id", F.col("l.dst_url").alias("url")).distinct()
    types = pages.select("site_id", "url", "page_type").filter(F.col("page_type") != "home")
    counted = out.join(types, ["site_id", "url"]).groupBy("site_id").agg(
        F.count_distinct("page_type").cast("int").alias("linked_types")
    )
    return homes.select("site_id").join(counted, "site_id", "left").select(
        "site_id", F.coalesce("linked_types", F.lit(0)).alias("linked_types")
    )
