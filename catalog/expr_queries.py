"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derive as D
from catalog import sql_parts as P
from catalog.registry import query
from citeframe.functions import numbers as N
from citeframe.functions import text as T
from citeframe.functions import urls as U
from citeframe.operators.extract import extract_pages, spread

GIVEN_URL = "regexp_replace(regexp_replace(url, '#.*$', ''), '/+(\\?|$)', '\\1')"
_RAW = f"SELECT DISTINCT page FROM ({D.SEARCH_ROWS}) AS s"
_BARE = "regexp_replace(page, '#.*$', '')"
_LOWER = f"lower(regexp_extract({_BARE}, '^[a-z]+://[^/]*')) || regexp_replace({_BARE}, '^[a-z]+://[^/]*', '')"
_COMPARABLE = f"CASE WHEN regexp_matches({_LOWER}, '^[a-z]+://[^/]*/*$') THEN regexp_replace({_LOWER}, '/*$', '/') ELSE regexp_replace({_LOWER}, '/+$', '') END"
SEARCH_KEY = f"regexp_replace({_COMPARABLE}, '^https?://(www\\.)?', 'https://')"


@query("u1_comparable_url", f"SELECT page, {_COMPARABLE} AS comparable FROM ({_RAW}) AS r UNION ALL SELECT url AS page, {GIVEN_URL} AS comparable FROM pages")
def u1(spark, sf):
    rows = D.derived(spark, sf, _RAW).unionByName(D.table(spark, sf, "pages").select(F.col("url").alias("page")))
    return rows.select("page", U.comparable_url(F.col("page")).alias("comparable"))


@query("u2_search_url", f"SELECT page, {SEARCH_KEY} AS search_key FROM ({_RAW}) AS r")
def u2(spark, sf):
    return D.derived(spark, sf, _RAW).select("page", U.search_url(F.col("page")).alias("search_key"))


_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '^www\\.', '')"


@query("u3_domain", f"SELECT page_id, {_HOST} AS domain, {_HOST} AS bare FROM pages")
def u3(spark, sf):
    bare = F.regexp_extract("url", "://([^/?#]+)", 1)
    return D.table(spark, sf, "pages").select("page_id", U.url_domain(F.col("url")).alias("domain"), U.url_domain(bare).alias("bare"))


@query("u4_domain_in", f"""SELECT page_id, {_HOST} = r OR ends_with({_HOST}, '.' || r) AS inside FROM (
    SELECT *, CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.net' ELSE {_HOST} END AS r FROM pages) AS p""")
def u4(spark, sf):
    df = D.table(spark, sf, "pages").withColumn("d", U.url_domain(F.col("url")))
    root = F.when(F.col("page_id") % 3 == 0, "example.com").when(F.col("page_id") % 3 == 1, "example.net").otherwise(F.col("d"))
    return df.select("page_id", U.domain_in(F.col("d"), root).alias("inside"))


@query("u5_slug", f"SELECT conv_id, turn, {P.slug('text')} AS slug FROM conversations")
def u5(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", T.slug(F.col("text")).alias("slug"))


_WANTED = "with from that the dans avec pour nicht einen Documentation pricing"


@query("u6_keyword_coverage", f"SELECT doc_id, round({P.coverage('text', chr(39) + _WANTED + chr(39))}, 6) AS coverage, len({P.tokens('text')}) AS n_tokens FROM documents")
def u6(spark, sf):
    df = D.table(spark, sf, "documents")
    return df.select(
        "doc_id", F.round(T.keyword_coverage(F.lower("text"), F.lit(_WANTED)), 6).alias("coverage"),
        F.size(F.array_distinct(T.keyword_tokens(F.col("text")))).alias("n_tokens"),
    )


@query("u7_glob_match", "SELECT page_id, regexp_matches(url, '(?i)^.*/EN/.*$') OR regexp_matches(url, '(?i)^http://.*.page=2.*$') AS matched FROM pages")
def u7(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.glob_match(F.col("url"), ["*/EN/*", "http://*?page=2*"]).alias("matched"))


@query("u8_word_count", f"SELECT doc_id, {P.words('text')} AS word_count FROM documents")
def u8(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@query("u9_clean_text", f"SELECT conv_id, turn, {P.clean('text', 180)} AS cleaned FROM conversations")
def u9(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", T.clean_text(F.col("text"), 180).alias("cleaned"))


_TERMS = ["the of", "license", "copyright", "@", "ß", "über", "ción", "password", "http"]


@query("u10_term_hits", f"SELECT doc_id, array_to_string(list_filter({P.text_list(_TERMS)}, lambda w: contains(lower(text), w)), '|') AS hits FROM documents")
def u10(spark, sf):
    df = D.table(spark, sf, "documents").withColumn("lower", F.lower("text"))
    return df.select("doc_id", F.array_join(T.term_hits(F.col("lower"), _TERMS), "|").alias("hits"))


@query("u11_regex_examples", f"""SELECT doc_id, array_to_string({P.firsts("regexp_extract_all(text, '[0-9]+[a-z]*|[A-Z][a-z]+on[ .]')")}, '|') AS examples FROM documents""")
def u11(spark, sf):
    found = T.regex_examples(F.col("text"), "[0-9]+[a-z]*|[A-Z][a-z]+on[ .]")
    return D.table(spark, sf, "documents").select("doc_id", F.array_join(found, "|").alias("examples"))


@query("u12_rounding", """SELECT event_id, CAST(floor(value / 37 * 100 + 0.5) AS INTEGER) AS pct, floor(value / 37 * 100 + 0.5) / 100 AS score,
    least(20.0, greatest(5.0, value)) AS clamped FROM events""")
def u12(spark, sf):
    v = F.col("value")
    return D.table(spark, sf, "events").select(
        "event_id", N.round_percent(v / 37).alias("pct"), N.round_score(v / 37).alias("score"), N.clamp(v, 5.0, 20.0).alias("clamped")
    )


@query("u13_rank_score", """SELECT event_id, CASE nullif(event_id % 7, 0) WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 WHEN 4 THEN 0.25
    WHEN 5 THEN 0.0 WHEN 6 THEN 0.0 END::DOUBLE AS score FROM events""")
def u13(spark, sf):
    return D.table(spark, sf, "events").select("event_id", N.rank_score(F.nullif(F.col("event_id") % 7, F.lit(0))).alias("score"))


GIVEN_LINKS = f"""links AS (
  SELECT page_id, url, href, anchor, ord - 1 AS ord FROM (
    SELECT page_id, {GIVEN_URL} AS url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
      unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS anchor,
      generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS ord FROM pages) AS x),
hrefs AS (SELECT page_id, url, ord, {P.unescape('href')} AS href, {P.unescape('anchor')} AS anchor FROM links),
resolved AS (
  SELECT *, lower(regexp_extract(url, '^[a-z]+://[^/]+')) || CASE WHEN regexp_matches(href, '^/+$') THEN '/' ELSE regexp_replace({P.encoded('href')}, '/+$', '') END AS dst
  FROM hrefs)"""


@query("u14_absolute_url", f"WITH {GIVEN_LINKS} SELECT page_id, ord, href, dst FROM resolved")
def u14(spark, sf):
    raw = D.table(spark, sf, "pages").select("page_id", U.comparable_url(F.col("url")).alias("url"), "html")
    links = extract_pages(spread(raw)).select("page_id", "url", F.posexplode("raw_links").alias("ord", "l"))
    return links.select("page_id", "ord", F.col("l.href").alias("href"), U.absolute_url(F.col("url"), F.col("l.href")).alias("dst"))


@query("u15_config_hash", """SELECT page_id, left(sha256('{"page_id":' || page_id || ',"url":"' || url || '","include":null}'), 16) AS hash FROM pages""")
def u15(spark, sf):
    empty = F.lit(None).cast("string").alias("include")
    return D.table(spark, sf, "pages").select("page_id", N.config_hash(F.col("page_id"), F.col("url"), empty).alias("hash"))


@query("u16_compact_evidence", "SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) > 0)[1:3], '; ') AS shown FROM conversations")
def u16(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", T.compact_evidence(F.split("text", " ")).alias("shown"))


