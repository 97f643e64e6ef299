"""Search validation over rows derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derive as D
from catalog import sql_parts as P
from catalog.expr_queries import SEARCH_KEY
from catalog.registry import features, issues, joined, query, shared, sites
from citeframe.operators import search as S

_ROWS = f"rows_s AS (SELECT *, {SEARCH_KEY} AS search_key FROM ({D.SEARCH_ROWS}) AS r)"
_AGG = f"""{_ROWS},
agg AS (
  SELECT site_id, source, search_key, max_by(page, row_no) AS page, sum(clicks) AS clicks, sum(impressions) AS impressions,
    sum(ctr * CASE WHEN impressions > 0 THEN impressions ELSE 1 END) / sum(CASE WHEN impressions > 0 THEN impressions ELSE 1 END) AS ctr,
    sum(position * CASE WHEN impressions > 0 THEN impressions ELSE 1 END) / sum(CASE WHEN impressions > 0 THEN impressions ELSE 1 END) AS position
  FROM rows_s GROUP BY 1, 2, 3)"""
_SEV = "CASE severity WHEN 'error' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END"
_MATCH = f"""{_AGG},
audited AS (SELECT site_id, CASE WHEN url LIKE '%.com' THEN url || '/' ELSE url END AS search_key, url, page_type FROM f),
per_page AS (
  SELECT site_id, page_url AS search_key, count(*) AS n, max_by(severity, {_SEV}) AS top, list(title ORDER BY {P.SEQ})[1:3] AS titles, list(issue_id ORDER BY {P.SEQ}) AS ids
  FROM issues WHERE page_url IS NOT NULL GROUP BY 1, 2),
base AS (SELECT a.*, regexp_extract(a.search_key, '://([^/]+)', 1) AS domain, s.base_url FROM agg AS a LEFT JOIN sites AS s USING (site_id)),
scoped AS (SELECT *, coalesce(domain <> substring(base_url, 9) AND NOT ends_with(domain, '.' || substring(base_url, 9)), TRUE) AS out_of_scope FROM base),
matched AS (
  SELECT b.site_id, b.source, b.search_key, b.page, b.domain, b.clicks, b.impressions, b.ctr, b.position, b.out_of_scope, u.url AS matched_url, u.page_type AS matched_page_type,
    b.impressions > 0 AS has_evidence, b.clicks > 0 AS has_clicks, CASE WHEN u.url IS NULL THEN 0 ELSE coalesce(i.n, 0) END AS audit_issue_count,
    CASE WHEN u.url IS NOT NULL THEN i.top END AS highest_severity, CASE WHEN u.url IS NOT NULL THEN i.titles END AS titles, CASE WHEN u.url IS NOT NULL THEN i.ids END AS ids
  FROM scoped AS b LEFT JOIN audited AS u ON u.site_id = b.site_id AND u.search_key = b.search_key AND NOT b.out_of_scope
    LEFT JOIN per_page AS i ON i.site_id = b.site_id AND i.search_key = b.search_key),
proof_pages AS (SELECT site_id, url, page_type FROM f WHERE page_type NOT IN ('home', 'product', 'other')),
cover AS (
  SELECT p.site_id, src AS source, p.url AS page_url, p.page_type, coalesce(bool_or(m.has_evidence), FALSE) AS has_evidence, coalesce(sum(m.impressions), 0.0) AS impressions, coalesce(sum(m.clicks), 0.0) AS clicks
  FROM proof_pages AS p, (SELECT unnest(['search-console', 'bing-webmaster']) AS src) AS q
    LEFT JOIN matched AS m ON m.site_id = p.site_id AND m.matched_url = p.url AND m.source = src GROUP BY 1, 2, 3, 4)"""
_WITH = P.with_issues(_MATCH)
_LABEL = "CASE source WHEN 'search-console' THEN 'Search Console' ELSE 'Bing Webmaster' END"


def _rows(spark, sf):
    return D.derived(spark, sf, D.SEARCH_ROWS)


def _matched(spark, sf):
    def build():
        return S.match_search_pages(S.aggregate_search(_rows(spark, sf)), features(spark, sf), issues(spark, sf), sites(spark, sf))

    return shared(spark, sf, "search-pages", build)


def _cover(spark, sf):
    both = [S.key_page_coverage(features(spark, sf), _matched(spark, sf), s) for s in ("search-console", "bing-webmaster")]
    return both[0].unionByName(both[1])


@query("a7_aggregate_search", f"WITH {_AGG} SELECT site_id, source, search_key, page, clicks, impressions, round(ctr, 6) AS ctr, round(position, 6) AS position FROM agg")
def a7(spark, sf):
    df = S.aggregate_search(_rows(spark, sf))
    return df.withColumns({"ctr": F.round("ctr", 6), "position": F.round("position", 6)})


@query("j4_match_search_pages", _WITH + """ SELECT site_id, source, search_key, page, domain, clicks, impressions, out_of_scope, matched_url, matched_page_type, has_evidence, has_clicks,
    audit_issue_count, highest_severity FROM matched""")
def j4(spark, sf):
    return _matched(spark, sf).drop("ctr", "position", "first_titles", "issue_ids")


@query("a8_key_page_coverage", _WITH + " SELECT * FROM cover")
def a8(spark, sf):
    return _cover(spark, sf)


@query("w4_sort_coverage", _WITH + " SELECT *, row_number() OVER (PARTITION BY site_id, source ORDER BY impressions DESC, page_url) AS coverage_ord FROM cover")
def w4(spark, sf):
    return S.sort_coverage(_cover(spark, sf))


@query("a9_search_summary", _WITH + """, t AS (
    SELECT site_id, source, count(*) AS imported_page_count, count(matched_url) AS matched_page_count, count(*) FILTER (out_of_scope) AS out_of_scope_page_count,
      count(*) FILTER (NOT out_of_scope AND has_clicks) AS pages_with_clicks, count(*) FILTER (NOT out_of_scope AND has_evidence) AS pages_with_impressions,
      coalesce(sum(clicks) FILTER (NOT out_of_scope), 0.0) AS total_clicks, coalesce(sum(impressions) FILTER (NOT out_of_scope), 0.0) AS total_impressions FROM matched GROUP BY 1, 2),
  k AS (SELECT site_id, source, count(*) FILTER (has_evidence) AS a, count(*) FILTER (NOT has_evidence) AS b FROM cover GROUP BY 1, 2)
  SELECT t.*, coalesce(k.a, 0) AS key_pages_with_evidence, coalesce(k.b, 0) AS key_pages_without_evidence FROM t LEFT JOIN k USING (site_id, source)""")
def a9(spark, sf):
    return S.search_summary(_matched(spark, sf), _cover(spark, sf))


@query("w3_top_search_pages", _WITH + """ SELECT site_id, top_ord, source, page, impressions, clicks FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, source ORDER BY impressions DESC, clicks DESC, page) AS top_ord FROM matched WHERE NOT out_of_scope) AS x WHERE top_ord <= 10""")
def w3(spark, sf):
    both = [S.top_search_pages(_matched(spark, sf).filter(F.col("source") == s)) for s in ("search-console", "bing-webmaster")]
    return both[0].unionByName(both[1]).select("site_id", "top_ord", "source", "page", "impressions", "clicks")


_FIND = ["site_id", "source", "finding_id", "severity", "title", "page_url", "page_type", "evidence"]


@query("v1_no_evidence_findings", _WITH + f""" SELECT site_id, source, source || '-no-evidence-' || page_type || '-' || {P.slug('page_url')} AS finding_id,
    CASE WHEN page_type IN ('pricing', 'security', 'docs') THEN 'warn' ELSE 'info' END AS severity, 'Key page has no ' || {_LABEL} || ' evidence' AS title, page_url, page_type,
    'Expected evidence on ' || page_url AS evidence FROM cover WHERE NOT has_evidence""")
def v1(spark, sf):
    return S.no_evidence_findings(_cover(spark, sf)).select(*_FIND)


_V2 = f"""SELECT site_id, source, source || '-not-crawled-' || {P.slug('page')} AS finding_id, 'warn' AS severity, {_LABEL} || ' page is not covered by crawl' AS title,
    page AS page_url, CAST(NULL AS VARCHAR) AS page_type, CAST(impressions AS BIGINT) || ' impressions, ' || CAST(clicks AS BIGINT) || ' clicks' AS evidence
    FROM matched WHERE NOT out_of_scope AND has_evidence AND matched_url IS NULL"""


@query("v2_not_crawled_findings", _WITH + " " + _V2)
def v2(spark, sf):
    return S.not_crawled_findings(_matched(spark, sf)).select(*_FIND)


@query("v3_blocker_findings", _WITH + f""" SELECT site_id, source, source || '-audit-blockers-' || {P.slug('page')} AS finding_id, highest_severity AS severity,
    {_LABEL} || '-visible page still has audit blockers' AS title, matched_url AS page_url, matched_page_type AS page_type, array_to_string(titles, '; ') AS evidence,
    array_to_string(ids, '|') AS related_issue_ids FROM matched WHERE NOT out_of_scope AND has_evidence AND matched_url IS NOT NULL AND audit_issue_count > 0""")
def v3(spark, sf):
    return S.blocker_findings(_matched(spark, sf)).select(*_FIND, joined("related_issue_ids"))


@query("v4_both_sources", _WITH + """ SELECT source, count(*) AS n_pages, count(matched_url) AS n_matched, count(*) FILTER (NOT out_of_scope AND has_evidence AND matched_url IS NULL) AS n_not_crawled
    FROM matched GROUP BY 1""")
def v4(spark, sf):
    df = _matched(spark, sf)
    lost = S.not_crawled_findings(df).groupBy("source").agg(F.count("*").alias("n_not_crawled"))
    counts = df.groupBy("source").agg(F.count("*").alias("n_pages"), F.count("matched_url").alias("n_matched"))
    return counts.join(lost, "source", "left").na.fill(0, ["n_not_crawled"])
