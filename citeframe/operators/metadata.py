"""Cross-page metadata consistency: canonicals, sitemaps, head tags, languages, JSON-LD, links.

Input pages carry the P1 parts (with ``site_text``) and ``url``. Every check returns rows of
(site_id, url, rule, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe import constants as C
from citeframe.functions import text as T
from citeframe.functions import urls as U
from citeframe.operators.joins import lookup_join
from citeframe.operators.jsonld import as_list, is_object, string_at


def _found(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.coalesce(detail, F.lit("")).alias("detail"))


def _rows(df: DataFrame, checks: list[Column], url: str = "url") -> DataFrame:
    hits = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return df.select("site_id", F.col(url).alias("url"), F.explode(hits).alias("f")).select("site_id", "url", "f.*")


def _many(df: DataFrame, found: Column) -> DataFrame:
    return df.select("site_id", "url", F.explode(found).alias("f")).select("site_id", "url", "f.*")


def real_pages(pages: DataFrame) -> DataFrame:
    """Pages that are no redirect shims (a refresh tag and no h1)."""
    return pages.filter(~(F.col("refresh").isNotNull() & (F.col("h1_count") == 0)))


def canonical_pages(pages: DataFrame) -> DataFrame:
    """First real page per canonical; the later checks look at these."""
    named = real_pages(pages).filter(F.length("canonical") > 0)
    firsts = named.groupBy("site_id", "canonical").agg(F.min("url").alias("url"))
    return named.join(firsts, ["site_id", "canonical", "url"], "left_semi")


def canonical_findings(pages: DataFrame) -> DataFrame:
    """No canonical; a canonical that an earlier page already uses."""
    real = real_pages(pages).select("site_id", "url", "canonical")
    unnamed = F.length(F.coalesce("canonical", F.lit(""))) == 0
    none = real.filter(unnamed).select("site_id", "url", F.lit("canonical-missing").alias("rule"), F.lit("").alias("detail"))
    named = real.filter(~unnamed)
    first = named.groupBy("site_id", "canonical").agg(F.min("url").alias("_first"))
    again = lookup_join(named, first, ["site_id", "canonical"], measured=True).filter("url <> _first")
    return none.unionByName(again.select("site_id", "url", F.lit("canonical-duplicate").alias("rule"), F.col("canonical").alias("detail")))


def sitemap_findings(pages: DataFrame, locs: DataFrame, sites: DataFrame) -> DataFrame:
    """Canonicals not in the sitemap, root missing, urls without page or off site, repeats.

    Set differences are anti joins on (site, url), which pre-aggregate to distinct urls.
    """
    listed = locs.groupBy("site_id", F.col("loc").alias("url")).agg(F.count("*").alias("n"))
    keys = listed.select("site_id", "url")
    real = real_pages(pages).filter(F.length("canonical") > 0).select("site_id", F.col("url").alias("page"), F.col("canonical").alias("url"))
    out = lookup_join(real, keys, ["site_id", "url"], "left_anti").select(
        "site_id", F.col("page").alias("url"), F.lit("sitemap-missing-canonical").alias("rule"), F.col("url").alias("detail")
    )
    roots = sites.select("site_id", F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/")).alias("url"))
    no_root = roots.join(keys, ["site_id", "url"], "left_anti").select(
        "site_id", "url", F.lit("sitemap-missing-root").alias("rule"), F.lit("").alias("detail")
    )
    placed = listed.join(roots.select("site_id", F.col("url").alias("_root")), "site_id")
    outside = ~F.startswith("url", F.col("_root"))
    off = placed.filter(outside).select("site_id", "url", F.lit("sitemap-outside-site").alias("rule"), F.lit("").alias("detail"))
    stored = pages.select("site_id", U.comparable_url(F.col("url")).alias("_key")).distinct()
    inside = placed.filter(~outside).withColumn("_key", U.comparable_url(F.col("url")))
    lost = inside.join(stored, ["site_id", "_key"], "left_anti").select(
        "site_id", "url", F.lit("sitemap-page-missing").alias("rule"), F.lit("").alias("detail")
    )
    repeats = listed.filter("n > 1").select(
        "site_id", "url", F.lit("sitemap-duplicate-url").alias("rule"), (F.col("n") - 1).cast("string").alias("detail")
    )
    return out.unionByName(no_root).unionByName(off).unionByName(lost).unionByName(repeats)


def _meta(name: str) -> Column:
    """First non-empty content of a head tag."""
    hits = F.filter("metas", lambda m: m["name"] == name)
    value = T.trimmed(F.try_element_at(hits, F.lit(1))["content"])
    return F.when(F.length(value) > 0, value)


def _absolute(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^https?://[^/?#\\s]+"), F.lit(False))


def head_findings(pages: DataFrame) -> DataFrame:
    """Not exactly one h1, empty title or description, canonical that is no absolute url."""
    return _rows(
        pages,
        [
            F.when(F.col("h1_count") != 1, _found("h1-count", F.col("h1_count").cast("string"))),
            F.when(F.length("title") == 0, _found("title-missing", F.lit(""))),
            F.when(F.length("meta_description") == 0, _found("description-missing", F.lit(""))),
            F.when(F.col("canonical").isNotNull() & ~_absolute(F.col("canonical")), _found("canonical-absolute", F.col("canonical"))),
        ],
    )


def social_findings(pages: DataFrame) -> DataFrame:
    """Missing social tags, relative urls in them, og:url other than the canonical."""
    checks = [F.when(_meta(t).isNull(), _found("og-missing", F.lit(t))) for t in C.OPEN_GRAPH_TAGS]
    checks += [F.when(_meta(t).isNull(), _found("twitter-missing", F.lit(t))) for t in C.TWITTER_TAGS]
    checks += [
        F.when(_meta(t).isNotNull() & ~_absolute(_meta(t)), _found("social-url-absolute", F.lit(t))) for t in C.ABSOLUTE_URL_TAGS
    ]
    checks.append(F.when(_meta("og:url") != F.col("canonical"), _found("og-url-canonical", _meta("og:url"))))
    return _rows(pages, checks)


def _roots(pages: DataFrame) -> DataFrame:
    """Adds the top-level JSON-LD objects as ``_nodes``."""
    at_top = F.filter("jsonld_nodes", lambda n, i: F.get("jsonld_depths", i) == 0)
    return pages.withColumn("_nodes", F.transform(at_top, lambda n: F.try_parse_json(n)))


def _typed(name: str) -> Column:
    """First top-level object whose type is exactly ``name``."""
    return F.try_element_at(
        F.filter("_nodes", lambda n: F.coalesce(string_at(n, "$['@type']") == name, F.lit(False))), F.lit(1)
    )


def _language_home(canonical: Column) -> Column:
    home = F.regexp_extract(canonical, "^([a-z]+://[^/?#]*[^?#]*?/(?:en|zh))(?:/|$)", 1)
    return F.when(F.length(home) > 0, F.concat(home, F.lit("/")))


def home_product_findings(pages: DataFrame, version: str) -> DataFrame:
    """Language homes without product JSON-LD, or with another version or url."""
    homes = _roots(pages).filter(F.col("canonical").rlike("/(en|zh)/$")).withColumn("_app", _typed("SoftwareApplication"))
    app = F.col("_app")
    given, at = string_at(app, "$.softwareVersion"), string_at(app, "$.url")
    return _rows(
        homes,
        [
            F.when(app.isNull(), _found("jsonld-home-softwareapplication", F.lit(""))),
            F.when(app.isNotNull() & ~given.eqNullSafe(F.lit(version)), _found("jsonld-software-version", given)),
            F.when(~at.eqNullSafe(F.col("canonical")), _found("jsonld-home-url", at)),
        ],
    )


def alternates(pages: DataFrame) -> DataFrame:
    """Long table of language alternates, the last of each language on a page."""
    df = pages.select("site_id", "url", "canonical", F.posexplode("alternates").alias("ord", "a"))
    df = df.filter((F.length("a.hreflang") > 0) & (F.length("a.href") > 0))
    last = df.groupBy("site_id", "url", "canonical", F.col("a.hreflang").alias("hreflang")).agg(F.max_by("a.href", "ord").alias("href"))
    return last


def language_findings(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Missing, relative, not self-referring, wrong neutral default, target absent, not reciprocal."""

    def href(language: str) -> Column:
        hits = F.filter("alternates", lambda a: (a["hreflang"] == language) & (F.length(a["href"]) > 0))
        return F.try_element_at(hits, F.lit(-1))["href"]

    roots = sites.select("site_id", F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/")).alias("_root"))
    df = pages.join(roots, "site_id", "left")
    own = F.when(F.contains("canonical", F.lit("/zh/")), href("zh-CN")).otherwise(href("en"))
    route = F.when(
        F.startswith("canonical", F.col("_root")), F.expr("substring(canonical, length(_root) + 1)")
    )
    neutral = F.when(route.rlike("^(en|zh)/"), F.concat(F.col("_root"), F.regexp_replace(route, "^(en|zh)/", "")))
    checks = [F.when(href(x).isNull(), _found("hreflang-missing", F.lit(x))) for x in C.LANGUAGES]
    checks += [F.when(href(x).isNotNull() & ~_absolute(href(x)), _found("hreflang-absolute", F.lit(x))) for x in C.LANGUAGES]
    checks.append(F.when(~own.eqNullSafe(F.col("canonical")), _found("hreflang-self", own)))
    checks.append(F.when(neutral.isNotNull() & ~href("x-default").eqNullSafe(neutral), _found("hreflang-x-default-neutral", neutral)))
    local = _rows(df, checks)
    # every declared pair (page canonical, target): the target must exist and point back
    pairs = alternates(pages).filter(F.col("hreflang").isin("en", "zh-CN") & (F.col("href") != F.col("canonical")))
    known = pages.select("site_id", F.col("canonical").alias("href")).distinct()
    absent = lookup_join(pairs, known, ["site_id", "href"], "left_anti", measured=True).select(
        "site_id", "url", F.lit("hreflang-target-missing").alias("rule"), F.col("href").alias("detail")
    )
    back = pages.select("site_id", F.col("canonical").alias("href"), F.explode("alternates.href").alias("canonical")).distinct()
    one_way = lookup_join(pairs, known, ["site_id", "href"], "left_semi").join(back, ["site_id", "href", "canonical"], "left_anti")
    one_way = one_way.select("site_id", "url", F.lit("hreflang-reciprocal").alias("rule"), F.col("href").alias("detail"))
    return local.unionByName(absent).unionByName(one_way)


def jsonld_findings(pages: DataFrame) -> DataFrame:
    """No JSON-LD, claim-like fields, nested page without a breadcrumb."""
    df = _roots(pages).withColumn("_n", F.size("_nodes") + F.col("jsonld_invalid"))
    some = F.col("_n") > 0
    whole = F.array_join(F.filter("jsonld_nodes", lambda n, i: F.get("jsonld_depths", i) == 0), "\n")
    checks = [F.when(~some, _found("jsonld-missing", F.lit("")))]
    for field in C.FORBIDDEN_CLAIM_FIELDS:
        checks.append(F.when(some & F.contains(whole, F.lit(f'"{field}"')), _found("jsonld-forbidden-claim", F.lit(field))))
    nested = ~F.col("canonical").rlike("/(en|zh)/$")
    checks.append(F.when(some & nested & _typed("BreadcrumbList").isNull(), _found("jsonld-breadcrumb", F.lit(""))))
    return _rows(df, checks)


def _item_url(x: Column) -> Column:
    """Url of a breadcrumb entry: the item itself, its id, or its url."""
    return F.coalesce(string_at(x, "$.item"), string_at(x, "$.item['@id']"), string_at(x, "$.item.url"))


def jsonld_url_findings(pages: DataFrame) -> DataFrame:
    """Page objects whose url is not the canonical; breadcrumbs not running from the language home to the page."""
    df = _roots(pages)
    typed = F.filter("_nodes", lambda n: F.coalesce(string_at(n, "$['@type']").isin(C.PAGE_URL_TYPES), F.lit(False)))
    wrong = F.filter(typed, lambda n: ~string_at(n, "$.url").eqNullSafe(F.col("canonical")))
    urls = _many(df, F.transform(wrong, lambda n: _found("jsonld-url-canonical", string_at(n, "$['@type']"))))
    crumbs = df.withColumn("_crumb", _typed("BreadcrumbList")).filter(F.col("_crumb").isNotNull())
    items = F.coalesce(F.try_variant_get(F.col("_crumb"), "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))
    crumbs = crumbs.withColumns({"_first": _item_url(F.try_element_at(items, F.lit(1))), "_last": _item_url(F.try_element_at(items, F.lit(-1)))})
    home = _language_home(F.col("canonical"))
    trail = _rows(
        crumbs,
        [
            F.when(home.isNotNull() & ~F.col("_first").eqNullSafe(home), _found("jsonld-breadcrumb-home", F.col("_first"))),
            F.when(~F.col("_last").eqNullSafe(F.col("canonical")), _found("jsonld-breadcrumb-canonical", F.col("_last"))),
        ],
    )
    return urls.unionByName(trail)


def faq_findings(pages: DataFrame) -> DataFrame:
    """FAQ data off FAQ pages; questions the page does not show."""
    df = _roots(pages).withColumn("_faq", _typed("FAQPage")).filter(F.col("_faq").isNotNull())
    asked = F.coalesce(F.try_variant_get(F.col("_faq"), "$.mainEntity", "array<variant>"), F.array().cast("array<variant>"))
    names = F.transform(F.filter(asked, is_object), lambda q: T.trimmed(string_at(q, "$.name")))
    hidden = F.filter(names, lambda n: (F.length(n) > 0) & ~F.contains(F.col("site_text"), n))
    shown = _many(df, F.transform(hidden, lambda n: _found("jsonld-faq-visible", n)))
    off = F.when(~F.contains(U.url_path(F.col("canonical")), F.lit("/faq/")), _found("jsonld-faq-page-only", F.lit("")))
    return _rows(df, [off]).unionByName(shown)


def broken_links(pages: DataFrame) -> DataFrame:
    """Internal links, assets aside, whose target is no stored page.

    One missing target may hold most links: such targets are found beforehand and joined apart.
    """
    links = pages.select("site_id", "url", F.explode("links").alias("l")).filter("l.is_internal")
    links = links.select("site_id", "url", F.col("l.dst_url").alias("dst_url"))
    asset = F.lower(U.url_path(F.col("dst_url"))).rlike("\\.(" + "|".join(C.ASSET_EXTENSIONS) + ")$")
    targets = links.filter(~asset).withColumn("_key", F.regexp_replace("dst_url", "\\?.*$", ""))
    stored = pages.select("site_id", F.regexp_replace(U.comparable_url(F.col("url")), "\\?.*$", "").alias("_key")).distinct()
    lost = lookup_join(targets, stored, ["site_id", "_key"], "left_anti", measured=True)
    return lost.select("site_id", "url", F.lit("internal-link-missing").alias("rule"), F.col("dst_url").alias("detail"))


# fixed values: words that open an English sentence
SENTENCE_OPENERS = [
    "The", "This", "That", "These", "Those", "Open", "Run", "Review", "Download", "Use", "Start", "Release", "What",
    "Known", "Current", "Canonical", "Initial", "No", "Not",
]


def mixed_language(pages: DataFrame, language: str = "zh", allowed=(), openers=tuple(SENTENCE_OPENERS)) -> DataFrame:
    """English sentences (an opening word and six or more words after it) on pages below ``/language/``.

    Allowed terms are removed first; longer ones before shorter ones they contain.
    """
    text = F.col("site_text")
    if allowed:
        import re

        terms = "|".join(re.escape(t) for t in sorted(allowed, key=len, reverse=True))
        text = F.regexp_replace(text, terms, "")
    word = "[A-Za-z0-9`'\"()/#:.,-]+"
    # no white space is part of a word, so nothing is given back: the possessive form loops where the greedy one recurses
    sentence = f"{T.EDGE}(?:{'|'.join(openers)}){T.EDGE}(?:{T.SPACE}+{word}){{6,}}+"
    found = F.regexp_extract_all(text, F.lit(sentence), 0)
    df = pages.filter(F.contains(U.url_path(F.col("url")), F.lit(f"/{language}/")))
    return _many(df, F.transform(found, lambda s: _found("mixed-language-sentence", T.trimmed(s))))


def metadata_findings(pages: DataFrame, locs: DataFrame, sites: DataFrame, version: str, allowed=()) -> DataFrame:
    """All families over a staged feature table."""
    firsts = canonical_pages(pages)
    parts = [
        canonical_findings(pages), sitemap_findings(pages, locs, sites), head_findings(firsts), social_findings(firsts),
        home_product_findings(firsts, version), language_findings(firsts, sites), jsonld_findings(firsts),
        jsonld_url_findings(firsts), faq_findings(firsts), broken_links(pages), mixed_language(firsts, allowed=allowed),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
