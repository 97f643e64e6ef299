"""Cross-page metadata consistency over language pairs derived from the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derive as D
from catalog import sql_parts as P
from catalog.registry import ORACLES, query, shared
from citeframe import constants as C
from citeframe.operators import metadata as M
from citeframe.operators.features import page_features

def _tag(name: str, key: str = "name") -> str:
    """Trimmed content of a head tag, null when empty or absent."""
    return f"nullif(trim(regexp_extract(html, '<meta {key}=\"{name}\" content=\"([^\"]*)\"', 1)), '')"


def _alternate(language: str) -> str:
    return f"nullif(regexp_extract(html, 'hreflang=\"{language}\" href=\"([^\"]*)\"', 1), '')"


_LD_TEXT = "regexp_extract(html, '<script type=\"application/ld\\+json\">(.*?)</script>', 1, 's')"
# everything below is read from the html itself
_M = f"""m0 AS (SELECT page_id, site_id, base_url, url, html, nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), '') AS can,
    regexp_extract(url, '/(en|zh)/', 1) AS lang, regexp_extract(html, '(?s)<title>([^<]*)</title>', 1) AS title,
    {_tag("description")} AS description, len(regexp_extract_all(html, '<h1>')) AS h1s, {_LD_TEXT} AS ld,
    {_alternate("en")} AS en, {_alternate("zh-CN")} AS zh, {_alternate("x-default")} AS xd FROM ({D.META_PAGES}) AS p),
m AS (SELECT *, CASE WHEN ld <> '' AND json_valid(ld) THEN json_extract(ld, '$[*]') ELSE [] END AS nodes FROM m0),
mp AS (SELECT *, can IS NOT NULL AND url = min(url) OVER (PARTITION BY site_id, can) AS is_first FROM m),
first AS (SELECT *, {{node}} FROM mp WHERE is_first)""".replace("{node}", ", ".join(
    f"list_filter(nodes, lambda x: json_extract_string(x, '$.\"@type\"') = '{t}')[1] AS {c}"
    for t, c in (("SoftwareApplication", "app"), ("BreadcrumbList", "crumb"), ("FAQPage", "faq"))
))
_W = f"WITH {_M}, sites AS ({D.META_SITES}), locs AS ({D.META_LOCS}) "


def _url(x: str) -> str:
    """Comparable form of the derived urls: no slash at the end but for the root."""
    return f"CASE WHEN regexp_matches({x}, '^https?://[^/]+/?$') THEN {x} ELSE regexp_replace({x}, '/$', '') END"


def _sites(spark, sf):
    return D.derived(spark, sf, D.META_SITES)


def _pages(spark, sf):
    def build():
        raw = D.derived(spark, sf, D.META_PAGES).select("site_id", "url", F.lit(200).alias("status"), F.lit(None).cast("string").alias("fetch_error"), "html")
        return page_features(raw, _sites(spark, sf), keep_site_text=True)

    return shared(spark, sf, "meta-features", build)


def _firsts(spark, sf):
    return M.canonical_pages(_pages(spark, sf))


_OUT = ["site_id", "url", "rule", "detail"]


def _sel(rule: str, where: str, detail: str = "''", source: str = "first") -> str:
    return f"SELECT site_id, url, '{rule}' AS rule, {detail} AS detail FROM {source} WHERE {where}"


def _all(*parts: str) -> str:
    return _W + " UNION ALL ".join(parts)


@query("d1_canonical_findings", _all(
    _sel("canonical-missing", "can IS NULL", source="mp"),
    _sel("canonical-duplicate", "can IS NOT NULL AND NOT is_first", "can", "mp")))
def d1(spark, sf):
    return M.canonical_findings(_pages(spark, sf)).select(*_OUT)


_LISTED = "(SELECT site_id, loc, count(*) AS n FROM locs GROUP BY 1, 2)"


@query("d2_sitemap_findings", _all(
    _sel("sitemap-missing-canonical", "can IS NOT NULL AND NOT EXISTS (SELECT 1 FROM locs AS l WHERE l.site_id = mp.site_id AND l.loc = can)", "can", "mp"),
    "SELECT site_id, base_url || '/' AS url, 'sitemap-missing-root' AS rule, '' AS detail FROM sites WHERE NOT EXISTS (SELECT 1 FROM locs AS l WHERE l.site_id = sites.site_id AND l.loc = base_url || '/')",
    f"SELECT l.site_id, l.loc AS url, 'sitemap-outside-site' AS rule, '' AS detail FROM {_LISTED} AS l JOIN sites USING (site_id) WHERE NOT starts_with(l.loc, base_url || '/')",
    f"""SELECT l.site_id, l.loc AS url, 'sitemap-page-missing' AS rule, '' AS detail FROM {_LISTED} AS l JOIN sites USING (site_id) WHERE starts_with(l.loc, base_url || '/')
      AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.site_id = l.site_id AND {_url('mp.url')} = {_url('l.loc')})"""))
def d2(spark, sf):
    df = M.sitemap_findings(_pages(spark, sf), D.derived(spark, sf, D.META_LOCS), _sites(spark, sf))
    return df.filter(F.col("rule") != "sitemap-duplicate-url").select(*_OUT)


@query("d3_sitemap_duplicates", _W + f"SELECT site_id, loc AS url, 'sitemap-duplicate-url' AS rule, CAST(n - 1 AS VARCHAR) AS detail FROM {_LISTED} AS l WHERE n > 1")
def d3(spark, sf):
    df = M.sitemap_findings(_pages(spark, sf), D.derived(spark, sf, D.META_LOCS), _sites(spark, sf))
    return df.filter(F.col("rule") == "sitemap-duplicate-url").select(*_OUT)


@query("d4_head_findings", _all(
    _sel("h1-count", "h1s <> 1", "CAST(h1s AS VARCHAR)"),
    _sel("title-missing", "trim(title) = ''"), _sel("description-missing", "description IS NULL"),
    _sel("canonical-absolute", "can LIKE '/%'", "can")))
def d4(spark, sf):
    return M.head_findings(_firsts(spark, sf)).select(*_OUT)


_SOCIAL = {t: _tag(t, "property") for t in C.OPEN_GRAPH_TAGS} | {t: _tag(t) for t in C.TWITTER_TAGS}


@query("d5_social_findings", _all(
    *(_sel("og-missing", f"{_SOCIAL[t]} IS NULL", f"'{t}'") for t in C.OPEN_GRAPH_TAGS),
    *(_sel("twitter-missing", f"{_SOCIAL[t]} IS NULL", f"'{t}'") for t in C.TWITTER_TAGS),
    *(_sel("social-url-absolute", f"NOT regexp_matches({_SOCIAL[t]}, '^https?://[^/?#]+')", f"'{t}'") for t in C.ABSOLUTE_URL_TAGS),
    _sel("og-url-canonical", f"{_SOCIAL['og:url']} <> can", _SOCIAL["og:url"])))
def d5(spark, sf):
    return M.social_findings(_firsts(spark, sf)).select(*_OUT)


_HOME = "regexp_matches(can, '/(en|zh)/$')"


@query("d6_home_product_findings", _all(
    _sel("jsonld-home-softwareapplication", f"{_HOME} AND app IS NULL"),
    _sel("jsonld-home-url", f"{_HOME} AND json_extract_string(app, '$.url') IS DISTINCT FROM can", "coalesce(json_extract_string(app, '$.url'), '')"),
    _sel("jsonld-software-version", f"{_HOME} AND app IS NOT NULL AND json_extract_string(app, '$.softwareVersion') IS DISTINCT FROM '1.0'",
         "coalesce(json_extract_string(app, '$.softwareVersion'), '')")))
def d6(spark, sf):
    return M.home_product_findings(_firsts(spark, sf), "1.0").select(*_OUT)


_ALT = """(SELECT *, CASE WHEN contains(can, '/zh/') THEN zh ELSE en END AS own,
    CASE WHEN starts_with(can, base_url || '/') AND regexp_matches(can, '^https://[^/]+/(en|zh)/') THEN base_url || '/' || regexp_replace(can, '^https://[^/]+/(en|zh)/', '') END AS neutral FROM first) AS a"""
_PAIRS = f"""(SELECT site_id, url, can, base_url, en AS href FROM {_ALT} WHERE en <> can UNION ALL SELECT site_id, url, can, base_url, zh FROM {_ALT} WHERE zh <> can) AS q"""


@query("d7_language_findings", _all(
    *(_sel("hreflang-missing", f"{c} IS NULL", f"'{x}'", _ALT) for c, x in (("en", "en"), ("zh", "zh-CN"), ("xd", "x-default"))),
    *(_sel("hreflang-absolute", f"NOT regexp_matches({c}, '^https?://[^/?#]+')", f"'{x}'", _ALT) for c, x in (("en", "en"), ("zh", "zh-CN"), ("xd", "x-default"))),
    _sel("hreflang-self", "own IS DISTINCT FROM can", "coalesce(own, '')", _ALT),
    _sel("hreflang-x-default-neutral", "neutral IS NOT NULL AND xd IS DISTINCT FROM neutral", "neutral", _ALT),
    _sel("hreflang-target-missing", "NOT EXISTS (SELECT 1 FROM first AS f2 WHERE f2.site_id = q.site_id AND f2.can = q.href)", "href", _PAIRS),
    _sel("hreflang-reciprocal", f"""EXISTS (SELECT 1 FROM first AS f2 WHERE f2.site_id = q.site_id AND f2.can = q.href)
      AND NOT EXISTS (SELECT 1 FROM {_ALT} WHERE a.site_id = q.site_id AND a.can = q.href AND (a.en = q.can OR a.zh = q.can OR a.xd = q.can))""", "href", _PAIRS)))
def d7(spark, sf):
    return M.language_findings(_firsts(spark, sf), _sites(spark, sf)).select(*_OUT)


@query("d8_jsonld_findings", _all(
    _sel("jsonld-missing", "ld = ''"),
    *(_sel("jsonld-forbidden-claim", f"json_valid(ld) AND contains(ld, '\"{field}\"')", f"'{field}'") for field in C.FORBIDDEN_CLAIM_FIELDS),
    _sel("jsonld-breadcrumb", f"ld <> '' AND NOT {_HOME} AND crumb IS NULL")))
def d8(spark, sf):
    return M.jsonld_findings(_firsts(spark, sf)).select(*_OUT)


_LAST_ITEM = "json_extract(crumb, '$.itemListElement[#-1].item')"
_ENDS = f"CASE json_type({_LAST_ITEM}) WHEN 'VARCHAR' THEN json_extract_string(crumb, '$.itemListElement[#-1].item') ELSE json_extract_string({_LAST_ITEM}, '$.\"@id\"') END"
_BEGINS = "json_extract_string(crumb, '$.itemListElement[0].item')"


@query("d9_jsonld_url_findings", _all(
    f"""SELECT site_id, url, 'jsonld-url-canonical' AS rule, json_extract_string(x, '$."@type"') AS detail FROM (SELECT site_id, url, can, unnest(nodes) AS x FROM first) AS f
      WHERE json_extract_string(x, '$."@type"') IN {tuple(C.PAGE_URL_TYPES)} AND json_extract_string(x, '$.url') IS DISTINCT FROM can""",
    _sel("jsonld-breadcrumb-home", f"crumb IS NOT NULL AND regexp_matches(can, '^https://[^/]+/(en|zh)/') AND {_BEGINS} IS DISTINCT FROM regexp_extract(can, '^https://[^/]+/(en|zh)/')", _BEGINS),
    _sel("jsonld-breadcrumb-canonical", f"crumb IS NOT NULL AND {_ENDS} IS DISTINCT FROM can", _ENDS)))
def d9(spark, sf):
    return M.jsonld_url_findings(_firsts(spark, sf)).select(*_OUT)


_SITE_TEXT = P.squash(P.unescape("regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"))


@query("d10_faq_findings", _all(
    _sel("jsonld-faq-page-only", "faq IS NOT NULL AND NOT regexp_matches(can, '^https?://[^/]+/(.*/)?faq/')"),
    f"""SELECT site_id, url, 'jsonld-faq-visible' AS rule, name AS detail FROM (
      SELECT site_id, url, {_SITE_TEXT} AS shown, unnest(json_extract_string(faq, '$.mainEntity[*].name')) AS name FROM first WHERE faq IS NOT NULL) AS q
      WHERE NOT contains(shown, name)"""))
def d10(spark, sf):
    return M.faq_findings(_firsts(spark, sf)).select(*_OUT)


_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)"
_TARGET = f"CASE WHEN starts_with(href, 'http') THEN regexp_replace(href, '/+$', '') ELSE base_url || regexp_replace({P.encoded('href')}, '/+$', '') END"


@query("d11_broken_links", _W + f"""SELECT site_id, url, 'internal-link-missing' AS rule, dst AS detail FROM (
    SELECT DISTINCT site_id, url, dst, anchor, context FROM (
      SELECT site_id, url, {_TARGET} AS dst, lower(anchor) AS anchor, '' AS context FROM (
        SELECT site_id, url, base_url, {P.unescape('href')} AS href, {P.unescape('anchor')} AS anchor FROM (
          SELECT site_id, url, base_url, unnest({_HREFS}) AS href, unnest({_HREFS.replace(', 1)', ', 2)')}) AS anchor FROM mp) AS x) AS y) AS z) AS l
    WHERE NOT regexp_matches(lower(dst), '\\.({"|".join(C.ASSET_EXTENSIONS)})$')
      AND NOT EXISTS (SELECT 1 FROM mp AS t WHERE t.site_id = l.site_id AND regexp_replace(t.url, '/$', '') = l.dst)""")
def d11(spark, sf):
    return M.broken_links(_pages(spark, sf)).select(*_OUT)


_WORD = "[A-Za-z0-9`''\"()/#:.,-]+"
_SENTENCE = f"\\b(?:{'|'.join(M.SENTENCE_OPENERS)})\\b(?:[\\s\u00a0\u3000]+{_WORD}){{6,}}"


@query("d12_mixed_language", _W + f"""SELECT site_id, url, 'mixed-language-sentence' AS rule, trim(unnest(regexp_extract_all(
    regexp_replace({_SITE_TEXT}, 'API tools|API', '', 'g'), '{_SENTENCE}'))) AS detail FROM first WHERE contains(url, '/zh/')""")
def d12(spark, sf):
    return M.mixed_language(_firsts(spark, sf), allowed=["API", "API tools"]).select(*_OUT)


_FAMILIES = " UNION ALL ".join(
    f"SELECT site_id, url, rule, detail FROM ({sql})" for name, sql in ORACLES.items() if name.startswith(tuple(f"d{i}_" for i in range(1, 13)))
)


@query("d_metadata_findings", _FAMILIES)
def d_all(spark, sf):
    return M.metadata_findings(
        _pages(spark, sf), D.derived(spark, sf, D.META_LOCS), _sites(spark, sf), "1.0", allowed=["API", "API tools"]
    ).select(*_OUT)
