"""Site audit: features, crawl plan, joins, rules, scores, top lists, briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derive as D
from catalog import sql_parts as P
from catalog.expr_queries import GIVEN_LINKS, GIVEN_URL
from catalog.registry import (
    brands, competitors, facts, features, given_pages, given_sites, issues, joined, query, robots, shared, sites,
)
from citeframe.operators import briefs, crawl, links, scores
from citeframe.operators import features as FE
from citeframe.operators import jsonld as J
from citeframe.operators import rules as R
from citeframe.operators.extract import extract_pages, spread
from citeframe.operators.rule_catalog import RULES, RuleBook
from citeframe.plans.audit import run_audit
from citeframe.sources.site_files import as_pages_raw, parse_sitemaps, reachable_sitemaps

# ---- page features over the given pages ---------------------------------------------------

_GIVEN = f"""given AS (
  SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS site_id, {GIVEN_URL} AS url, html,
    trim({P.unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
    trim({P.unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS h1,
    len(regexp_extract_all(html, '<h1>')) AS h1_count, len(regexp_extract_all(html, '<[uo]l>')) AS lists,
    len(regexp_extract_all(html, '<script')) AS scripts, {P.body_text('html')} AS body_text,
    len(regexp_extract_all(html, '<a href')) AS n_links FROM pages)"""


@query("p1_extract_pages", f"WITH {_GIVEN} SELECT site_id, url, title, h1, h1_count, lists, scripts, body_text, n_links, 0 AS tables, 0 AS controls FROM given")
def p1(spark, sf):
    df = extract_pages(spread(given_pages(spark, sf)))
    return df.select("site_id", "url", "title", "h1", "h1_count", "lists", "scripts", "body_text", F.size("raw_links").alias("n_links"), "tables", "controls")


@query("p1_extract_site_pages", P.with_sites() + """ SELECT url, title, meta_description, h1, h1_count, array_to_string(headings, '|') AS headings, lists,
    n_tables AS tables, scripts, noindex, controls, aria_controls, body_text FROM parts""")
def p1_sites(spark, sf):
    df = features(spark, sf)
    return df.select("url", "title", "meta_description", "h1", "h1_count", joined("headings"), "lists", "tables", "scripts", "noindex",
                     "controls", "aria_controls", "body_text")


@query("p2_classify_page_type", P.with_sites("features") + " SELECT site_id, url, page_type FROM f")
def p2(spark, sf):
    parts = extract_pages(spread(D.site_pages(spark, sf)))
    return FE.classify_page_type(parts, sites(spark, sf)).select("site_id", "url", "page_type")


_WORD_FLAG = "regexp_matches({x}, '(?i)\\b({w})\\b')"


@query("p3_page_flags", P.with_sites("features") + f""" SELECT url, word_count, noindex, snippet AS text_snippet, page_text, word_count < 120 AND scripts >= 5 AS js_heavy,
    {_WORD_FLAG.format(x='body_text', w='20[0-9][0-9]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec')} AS has_date,
    regexp_matches(body_text, '(?i)\\bv?[0-9]+\\.[0-9]+(\\.[0-9]+)?\\b') AS has_version,
    {_WORD_FLAG.format(x='body_text', w='soc ?2|iso ?27001|sso|saml|gdpr|encryption|audit log|hipaa|dpa')} AS has_trust,
    regexp_matches(body_text, '\\b[0-9]{{1,3}}(?:[.,][0-9]+)?%?\\b') AS has_numbers FROM f""")
def p3(spark, sf):
    return features(spark, sf).select("url", "word_count", "noindex", "text_snippet", "page_text", "js_heavy", "has_date", "has_version", "has_trust", "has_numbers")


@query("p3_flags_given", f"""WITH {_GIVEN} SELECT url, {P.words('body_text')} AS word_count,
    {_WORD_FLAG.format(x='body_text', w='20[0-9][0-9]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec')} AS has_date,
    regexp_matches(body_text, '\\b[0-9]{{1,3}}(?:[.,][0-9]+)?%?\\b') AS has_numbers FROM given""")
def p3_given(spark, sf):
    df = FE.derive_page_flags(FE.classify_page_type(extract_pages(spread(given_pages(spark, sf))), given_sites(spark, sf)))
    return df.select("url", "word_count", "has_date", "has_numbers")


@query("p4_explode_links", P.with_sites("links") + " SELECT site_id, src_url, dst_url, anchor_text, source_context FROM links")
def p4(spark, sf):
    df = links.explode_links(features(spark, sf)).filter("is_internal")
    return df.select("site_id", "src_url", "dst_url", "anchor_text", "source_context")


@query("p4_links_given", f"""WITH {GIVEN_LINKS} SELECT url AS src_url, dst AS dst_url, anchor AS anchor_text, min(ord) AS link_ord
    FROM resolved GROUP BY 1, 2, 3""")
def p4_given(spark, sf):
    df = links.explode_links(links.with_links(extract_pages(spread(given_pages(spark, sf)))))
    return df.groupBy("src_url", "dst_url", "anchor_text").agg(F.min("link_ord").alias("link_ord"))


@query("p5_explode_jsonld", P.with_sites("jsonld") + """ SELECT r.url, r.kind AS type, r.name, r.description, r.ld_url AS record_url, r.category,
    coalesce(q.n, 0) AS n_questions FROM records AS r LEFT JOIN (SELECT url, kind, count(*) AS n FROM questions GROUP BY ALL) AS q ON q.url = r.url AND q.kind = r.kind""")
def p5(spark, sf):
    df = features(spark, sf).select("site_id", F.col("url").alias("page"), "jsonld_records")
    df = df.select("page", F.explode("jsonld_records").alias("r"))
    return df.select(F.col("page").alias("url"), "r.type", "r.name", "r.description", F.col("r.url").alias("record_url"), "r.category",
                     F.size("r.questions").alias("n_questions"))


@query("p6_schema_signals", P.with_sites("jsonld") + " SELECT url, record_type, field, value, visible FROM signals")
def p6(spark, sf):
    return J.schema_signals(features(spark, sf)).select("url", "record_type", "field", "value", "visible")


@query("p7_evidence_signals", P.with_sites("features") + """ SELECT f.url, e.signal, e.n, array_to_string(e.examples, '|') AS examples
    FROM evidence AS e JOIN f USING (page_id)""")
def p7(spark, sf):
    return FE.evidence_signals(features(spark, sf)).select("url", "signal", "n", joined("examples"))


# ---- crawl plan -----------------------------------------------------------------------------


@query("c1_in_scope", """SELECT page_id, url FROM pages WHERE (page_id % 2 = 0 AND regexp_matches(url, '^[a-z]+://[^/]+/en(/|$|[?#])'))
    OR (page_id % 2 = 1 AND page_id % 3 <> 0)""")
def c1(spark, sf):
    df = D.table(spark, sf, "pages").withColumn("site_id", F.col("page_id").cast("string"))
    origin = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    base = F.when(F.col("page_id") % 2 == 0, F.concat(origin, F.lit("/en"))).when(F.col("page_id") % 3 == 0, F.lit("https://nowhere.example.com")).otherwise(F.concat(F.upper(origin), F.lit("/")))
    return crawl.in_scope(df.select("site_id", "page_id", "url"), df.select("site_id", base.alias("base_url"))).select("page_id", "url")


@query("c2_filter_patterns", """SELECT page_id, url FROM pages WHERE (contains(lower(url), '/en/') OR regexp_matches(url, '://[^/]+/f.*'))
    AND NOT regexp_matches(url, '\\.html$')""")
def c2(spark, sf):
    df = D.table(spark, sf, "pages").select("page_id", "url")
    return crawl.filter_patterns(df, include=["*/EN/*", "/f*"], exclude=["*.html"])


_LOC = "<(?:sm:)?loc>(?:<!\\[CDATA\\[)?([^<\\]]*)(?:\\]\\]>)?</(?:sm:)?loc>"
_LOCS = f"""locs AS (
  SELECT m.site_id, m.sitemap_url, replace(replace(trim(u), '&amp;', '&'), '&#38;', '&') AS loc FROM (
    SELECT site_id, sitemap_url, unnest(regexp_extract_all(regexp_replace(xml, '<!--.*?-->', ''), '{_LOC}', 1)) AS u FROM ({D.SITEMAPS}) AS x) AS m)"""


def _sitemaps(spark, sf):
    return D.derived(spark, sf, D.SITEMAPS)


@query("s3_sitemap_locs", f"WITH {_LOCS} SELECT site_id, sitemap_url, loc FROM locs WHERE NOT ends_with(loc, '.xml')")
def s3(spark, sf):
    return parse_sitemaps(_sitemaps(spark, sf))[0].select("site_id", "sitemap_url", "loc")


@query("s3_sitemap_nested", f"WITH {_LOCS} SELECT site_id, sitemap_url, loc FROM locs WHERE ends_with(loc, '.xml')")
def s3_nested(spark, sf):
    return parse_sitemaps(_sitemaps(spark, sf))[1].select("site_id", "sitemap_url", "loc")


_REACHED = f"""reached AS (
  SELECT DISTINCT l.site_id, l.loc FROM locs AS l JOIN locs AS i ON i.site_id = l.site_id AND i.loc = l.sitemap_url WHERE ends_with(i.sitemap_url, 'sitemap_index.xml')),
found AS (
  SELECT site_id, loc AS url FROM reached
  UNION SELECT p.site_id, p.url FROM ({D.SITE_PAGES}) AS p WHERE p.site_id NOT IN (SELECT site_id FROM reached)
  UNION SELECT s.site_id, s.base_url || '/' FROM ({D.SITES}) AS s WHERE s.site_id NOT IN (SELECT site_id FROM reached)
    AND s.site_id NOT IN (SELECT site_id FROM ({D.SITE_PAGES}) AS p))"""


def _found(spark, sf):
    reached = reachable_sitemaps(_sitemaps(spark, sf), sites(spark, sf), robots(spark, sf))
    return crawl.discover_urls(parse_sitemaps(reached)[0], sites(spark, sf), D.site_pages(spark, sf).select("site_id", "url"))


@query("c3_discover_urls", f"WITH {_LOCS}, {_REACHED} SELECT site_id, url FROM found")
def c3(spark, sf):
    return _found(spark, sf)


_GIVEN_PATH = "lower(regexp_extract(url, '^[a-z]+://[^/]+([^?]*)', 1))"


@query("c4_plan_targets", f"""SELECT site_id, url, crawl_rank, target_ord FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY crawl_rank, url) AS target_ord FROM (
      SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS site_id, {GIVEN_URL} AS url, {P.crawl_rank(_GIVEN_PATH)} AS crawl_rank FROM pages) AS x) AS y
    WHERE target_ord <= 5""")
def c4(spark, sf):
    return crawl.plan_targets(given_pages(spark, sf).select("site_id", "url").distinct(), max_pages=5)


@query("c4_plan_all", f"""SELECT site_id, url, crawl_rank, row_number() OVER (PARTITION BY site_id ORDER BY crawl_rank, url) AS target_ord FROM (
    SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS site_id, {GIVEN_URL} AS url, {P.crawl_rank(_GIVEN_PATH)} AS crawl_rank FROM pages) AS x""")
def c4_all(spark, sf):
    return crawl.plan_targets(given_pages(spark, sf).select("site_id", "url").distinct())


@query("c4_plan_site_targets", f"""WITH {_LOCS}, {_REACHED} SELECT site_id, url, target_ord FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {P.crawl_rank("lower(regexp_extract(url, '^[a-z]+://[^/]+([^?]*)', 1))")}, url) AS target_ord FROM found) AS x WHERE target_ord <= 3""")
def c4_sites(spark, sf):
    return crawl.plan_targets(_found(spark, sf), max_pages=3).select("site_id", "url", "target_ord")


@query("c5_resolve_redirects", P.with_sites("features") + """, moved AS (
    SELECT f.site_id, f.page_rank AS r, f.url AS src, base_url || '/pricing' AS url, f.status FROM f WHERE contains(html, 'http-equiv="refresh"') AND status = 200),
  direct AS (SELECT site_id, url, page_rank AS r, url AS src, status FROM f WHERE url NOT IN (SELECT src FROM moved WHERE src <> url)),
  every AS (
    SELECT site_id, url, r, src, status FROM direct
    UNION ALL SELECT m.site_id, m.url, m.r, m.src, coalesce(p.status, 404) FROM moved AS m LEFT JOIN f AS p ON p.url = m.url WHERE m.src <> m.url)
  SELECT site_id, url, status, crawl_rank FROM (SELECT *, r AS crawl_rank, row_number() OVER (PARTITION BY site_id, url ORDER BY r, src) AS n FROM every) AS x WHERE n = 1""")
def c5(spark, sf):
    raw = D.site_pages(spark, sf)
    refresh = extract_pages(spread(raw.select("site_id", "url", "html"))).select("site_id", "url", "refresh")
    pages = raw.drop("html").join(refresh, ["site_id", "url"])
    return crawl.resolve_redirects(pages, sites(spark, sf)).select("site_id", "url", "status", "crawl_rank")


@query("c6_key_pages", P.with_sites("features") + " SELECT url, page_type, page_type NOT IN ('home', 'product') AS proof FROM f WHERE page_type <> 'other'")
def c6(spark, sf):
    df = features(spark, sf)
    proof = crawl.key_pages(df, proof_only=True).select("url", F.lit(True).alias("proof"))
    return crawl.key_pages(df).select("url", "page_type").join(proof, "url", "left").na.fill(False, ["proof"])


# ---- joins ------------------------------------------------------------------------------------


@query("j1_incoming_links", P.with_sites("features", "links") + """ SELECT l.site_id, l.dst_url, t.page_type AS dst_page_type, l.src_url, s.page_type AS src_page_type, l.anchor_text
    FROM links AS l JOIN f AS t ON t.site_id = l.site_id AND t.url = l.dst_url JOIN f AS s ON s.page_id = l.page_id WHERE l.src_url <> l.dst_url""")
def j1(spark, sf):
    return links.incoming_links(features(spark, sf)).select("site_id", "dst_url", "dst_page_type", "src_url", "src_page_type", "anchor_text")


@query("j1_incoming_given", f"""WITH {GIVEN_LINKS} SELECT DISTINCT r.url AS src_url, r.dst AS dst_url FROM resolved AS r
    JOIN (SELECT DISTINCT {GIVEN_URL} AS url FROM pages) AS p ON p.url = r.dst WHERE r.url <> r.dst
    UNION SELECT src, dst FROM (SELECT {GIVEN_URL} AS src, {GIVEN_URL.replace('url', 'first_url')} AS dst FROM ({D.HOST_LINKED}) AS h) AS x WHERE src <> dst""")
def j1_given(spark, sf):
    pages = as_pages_raw(D.derived(spark, sf, D.HOST_LINKED).select("url", "html"))
    df = FE.derive_page_flags(FE.classify_page_type(extract_pages(spread(pages))))
    return links.incoming_links(links.with_links(df)).select("src_url", "dst_url").distinct()


@query("j2_homepage_linked_types", P.with_rules() + " SELECT h.site_id, coalesce(l.n, 0) AS linked_types FROM homes AS h LEFT JOIN linked AS l USING (site_id)")
def j2(spark, sf):
    return links.homepage_linked_types(features(spark, sf))


@query("j3_missing_page_types", P.with_sites("features", P.SITES) + """ SELECT s.site_id, t.page_type FROM sites AS s,
    (SELECT unnest(['pricing', 'security', 'docs', 'faq', 'compare', 'integrations']) AS page_type) AS t
    WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.site_id = s.site_id AND f.page_type = t.page_type)""")
def j3(spark, sf):
    return R.missing_page_types(features(spark, sf), sites(spark, sf)).select("site_id", "page_type")


# ---- rules ------------------------------------------------------------------------------------

_RULE_COLUMNS = "site_id, rule_id, severity, title, category, bucket, page_url"


def _rule(no: int):
    def run(spark, sf):
        df = issues(spark, sf).filter(F.col("rule_id") == f"R{no:02d}")
        return df.select("site_id", "rule_id", "severity", "title", "category", "bucket", "page_url")

    query(f"r{no:02d}_{RULES[no].title.lower().replace('{bot}', 'bot').translate({ord(c): '_' for c in ' -.&'})}", P.with_rules() + f" SELECT {_RULE_COLUMNS} FROM ({P.rule_select(no)}) AS x")(run)


for _no in range(1, 49):
    _rule(_no)


@query("r_audit_issues", P.with_issues() + f" SELECT issue_id, {_RULE_COLUMNS} FROM issues")
def r_all(spark, sf):
    df = R.audit_issues(features(spark, sf), sites(spark, sf), robots(spark, sf), brands(spark, sf), competitors(spark, sf))
    return df.select("issue_id", "site_id", "rule_id", "severity", "title", "category", "bucket", "page_url")


def _missing_groups(page_type: str) -> str:
    _, _, _, needed, groups = P.C.EVIDENCE_GROUPS[page_type]
    rows = ", ".join(f"{{'label': '{label}', 'kinds': {P.text_list(kinds)}}}" for label, kinds in groups)
    lost = "array_to_string([g.label FOR g IN groups IF NOT list_has_any(signals, g.kinds)], ', ')"
    return (
        f"SELECT url AS page_url, 'Missing: ' || {lost} AS missing FROM (SELECT *, [{rows}] AS groups FROM pf "
        f"WHERE is_ok AND page_type = '{page_type}' AND {P._groups(page_type)} < {needed}) AS x"
    )


@query("r_evidence_text", P.with_rules() + " " + " UNION ALL ".join(_missing_groups(t) for t in P.C.EVIDENCE_GROUPS))
def r_evidence(spark, sf):
    df = issues(spark, sf).filter(F.col("category") == "evidence")
    return df.select("page_url", F.substring_index("evidence", ". Present: ", 1).alias("missing"))


@query("f1_registered_rules", P.with_rules() + """ SELECT site_id, 'R101' AS rule_id, url AS page_url FROM pf WHERE is_ok AND lists > 1
    UNION ALL SELECT site_id, 'R102', NULL FROM sf WHERE coalesce(n_pages, 0) < 12 UNION ALL SELECT site_id, 'R103', NULL FROM sf WHERE linked_types = 1""")
def f1(spark, sf):
    book = RuleBook()
    common = {"severity": "info", "category": "structure", "bucket": "structure", "message": "m", "fix_hint": "h"}
    book.register_rule("page", 101, F.col("lists") > 1, title="Several lists", **common)
    book.register_rule("site", 102, F.col("n_pages") < 12, title="Few pages", **common)
    book.register_rule("final", 103, F.col("linked_types") == 1, title="One linked type", **common)
    df = R.audit_issues(features(spark, sf), sites(spark, sf), robots(spark, sf), brands(spark, sf), competitors(spark, sf), book=book)
    return df.filter(F.col("rule_id").isin("R101", "R102", "R103")).select("site_id", "rule_id", "page_url")


# ---- scores -----------------------------------------------------------------------------------

_SCORES = """spine AS (SELECT site_id, unnest(['access', 'structure', 'entityClarity', 'evidence', 'comparativeReadiness']) AS bucket FROM sites),
scored AS (
  SELECT s.site_id, s.bucket, CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'error' THEN 18 WHEN 'warn' THEN 8 WHEN 'info' THEN 3 END), 0)) AS INTEGER) AS score,
    count(i.rule_id) AS issue_count, count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warn') AS warn_count, count(*) FILTER (severity = 'info') AS info_count
  FROM spine AS s LEFT JOIN issues AS i ON i.site_id = s.site_id AND i.bucket = s.bucket GROUP BY ALL)"""


@query("a1_bucket_scores", P.with_issues(_SCORES) + " SELECT site_id, bucket, score, issue_count, error_count, warn_count, info_count FROM scored")
def a1(spark, sf):
    return scores.bucket_scores(issues(spark, sf), sites(spark, sf))


_GIVEN_ISSUES = f"""WITH {_GIVEN}, typed AS (
  SELECT *, {P.words('body_text')} AS word_count, {P.page_type("coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/]+([^?]*)', 1)), '/+$', ''), ''), '/')", 'title', 'h1')} AS page_type FROM given),
facts AS (
  SELECT site_id, count(*) FILTER (page_type = 'home') AS home, {", ".join(f"count(*) FILTER (page_type = '{t}') AS n{i}" for i, t in enumerate(['pricing', 'security', 'docs', 'faq', 'compare', 'integrations', 'use-case']))},
  count(*) FILTER (page_type <> 'other' AND page_type IN ('home', 'product', 'pricing', 'security', 'docs') AND word_count < 150) AS thin,
  count(*) FILTER (page_type <> 'other') AS n_key, count(*) FILTER (page_type <> 'other' AND length(title) BETWEEN 1 AND 19) AS n_short,
  count(*) FILTER (page_type <> 'other' AND title = '') AS n_untitled FROM typed GROUP BY 1)"""


@query("a1_given_missing_types", _GIVEN_ISSUES + " SELECT site_id, (n0 = 0)::INT + (n1 = 0)::INT + (n2 = 0)::INT + (n3 = 0)::INT + (n4 = 0)::INT + (n5 = 0)::INT AS n_missing, n_key, home > 0 AS has_home FROM facts")
def a1_given(spark, sf):
    df = FE.derive_page_flags(FE.classify_page_type(extract_pages(spread(given_pages(spark, sf))), given_sites(spark, sf)))
    pages = shared(spark, sf, "given", lambda: df.select("site_id", "url", "page_type"))
    missing = R.missing_page_types(pages, given_sites(spark, sf)).groupBy("site_id").agg(F.count("*").alias("n_missing"))
    counts = pages.groupBy("site_id").agg(
        F.count_if(F.col("page_type") != "other").alias("n_key"), F.bool_or(F.col("page_type") == "home").alias("has_home")
    )
    return counts.join(missing, "site_id", "left").na.fill(0, ["n_missing"]).select("site_id", "n_missing", "n_key", "has_home")


@query("a2_overall_score", P.with_issues(_SCORES) + " SELECT site_id, CAST(floor(avg(score) + 0.5) AS INTEGER) AS overall_score FROM scored GROUP BY 1")
def a2(spark, sf):
    return scores.overall_score(scores.bucket_scores(issues(spark, sf), sites(spark, sf)))


_SUMMARY = """SELECT s.site_id, (SELECT CAST(floor(avg(score) + 0.5) AS INTEGER) FROM scored AS x WHERE x.site_id = s.site_id) AS overall_score, {vavr},
    array_to_string([t FOR t IN ['pricing', 'security', 'docs', 'faq', 'compare', 'integrations'] IF NOT list_contains(coalesce(c.types, []), t)], '|') AS missing_page_types,
    coalesce(c.n, 0) AS crawled_pages, coalesce({discovered}, 0) AS discovered_urls, coalesce(c.n_key, 0) AS key_page_count
  FROM sites AS s LEFT JOIN (SELECT site_id, count(*) AS n, count(*) FILTER (page_type <> 'other') AS n_key, list(DISTINCT page_type) AS types FROM f GROUP BY 1) AS c USING (site_id)"""


def _audit_summary(spark, sf, discovered=None):
    buckets = scores.bucket_scores(issues(spark, sf), sites(spark, sf))
    return scores.audit_summary(sites(spark, sf), features(spark, sf), buckets, discovered)


@query("a3_audit_summary", P.with_issues(_SCORES) + " " + _SUMMARY.format(vavr="CAST(NULL AS INTEGER) AS vavr", discovered="c.n"))
def a3(spark, sf):
    return _audit_summary(spark, sf).withColumn("missing_page_types", joined("missing_page_types"))


@query("a3_summary_discovered", P.with_issues(_SCORES, _LOCS, _REACHED) + " " + _SUMMARY.format(
    vavr="CAST(NULL AS INTEGER) AS vavr", discovered="(SELECT count(*) FROM found AS d WHERE d.site_id = s.site_id)"))
def a3_discovered(spark, sf):
    return _audit_summary(spark, sf, _found(spark, sf)).withColumn("missing_page_types", joined("missing_page_types"))


_RECS = """per AS (SELECT s.site_id, count(*) FILTER (bucket = 'access') AS a, count(*) FILTER (bucket = 'structure') AS b, count(*) FILTER (bucket = 'entityClarity') AS c,
    count(*) FILTER (bucket = 'evidence') AS d, count(*) FILTER (bucket = 'comparativeReadiness') AS e,
    count(*) FILTER (rule_id IN ('R38', 'R39')) AS p, count(*) FILTER (rule_id BETWEEN 'R38' AND 'R43') AS m FROM sites AS s LEFT JOIN issues AS i USING (site_id) GROUP BY 1),
recs AS (SELECT site_id, 1 AS rec_ord, 'remove-crawl-blockers' AS rec_id, a AS issue_count FROM per WHERE a > 0
  UNION ALL SELECT site_id, 2, 'tighten-page-structure', b FROM per WHERE b > 0 UNION ALL SELECT site_id, 3, 'clarify-homepage-positioning', c FROM per WHERE c > 0
  UNION ALL SELECT site_id, 4, 'add-citable-evidence', d FROM per WHERE d > 0 OR p > 0 UNION ALL SELECT site_id, 5, 'close-comparison-gaps', e FROM per WHERE e > 0 OR m > 0)"""


def _recs(spark, sf):
    return scores.recommendations(issues(spark, sf), R.missing_page_types(features(spark, sf), sites(spark, sf)), sites(spark, sf))


@query("a4_recommendations", P.with_issues(_RECS) + " SELECT site_id, rec_ord, rec_id, issue_count FROM recs")
def a4(spark, sf):
    return _recs(spark, sf).select("site_id", "rec_ord", "rec_id", "issue_count")


@query("a4_recommendation_issues", P.with_issues() + """ SELECT site_id, CASE bucket WHEN 'access' THEN 'remove-crawl-blockers' WHEN 'structure' THEN 'tighten-page-structure'
    WHEN 'entityClarity' THEN 'clarify-homepage-positioning' WHEN 'evidence' THEN 'add-citable-evidence' ELSE 'close-comparison-gaps' END AS rec_id, issue_id FROM issues""")
def a4_issues(spark, sf):
    return scores.recommendation_issues(issues(spark, sf)).select("site_id", "rec_id", "issue_id")


@query("a5_page_type_counts", P.with_sites("features") + " SELECT site_id, page_type, count(*) AS n_pages FROM f GROUP BY 1, 2")
def a5(spark, sf):
    return R.page_type_counts(features(spark, sf))


_COVERAGE = """hits AS (SELECT c.site_id, c.comp_ord, c.name, f.url, f.page_rank FROM competitors AS c JOIN f ON f.site_id = c.site_id AND f.page_type = 'compare'
    AND contains(lower(f.title || ' ' || f.h1 || ' ' || f.snippet), lower(c.name))),
coverage AS (SELECT c.site_id, c.comp_ord, c.name, count(h.url) > 0 AS named, count(h.url) AS n_pages, min_by(h.url, h.url) AS first_page
  FROM competitors AS c LEFT JOIN hits AS h ON h.site_id = c.site_id AND h.name = c.name GROUP BY 1, 2, 3)"""


@query("a6_competitor_coverage", P.with_sites("features", P.COMPETITORS, _COVERAGE) + " SELECT * FROM coverage")
def a6(spark, sf):
    return scores.competitor_coverage(features(spark, sf), competitors(spark, sf))


@query("a6_competitor_gaps", P.with_sites("features", P.COMPETITORS, _COVERAGE) + " SELECT site_id, comp_ord, name FROM coverage WHERE NOT named")
def a6_gaps(spark, sf):
    return scores.competitor_gaps(scores.competitor_coverage(features(spark, sf), competitors(spark, sf)))


@query("w1_top_issues", P.with_issues() + f""" SELECT site_id, top_ord, severity, title, scope FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {P.SEQ}) AS top_ord FROM (
      SELECT *, coalesce(page_url, 'site') AS scope, row_number() OVER (PARTITION BY site_id, title ORDER BY {P.SEQ}) AS n FROM issues) AS x WHERE n = 1) AS y WHERE top_ord <= 3""")
def w1(spark, sf):
    return scores.top_issues(issues(spark, sf)).select("site_id", "top_ord", "severity", "title", "scope")


@query("w2_head_issues", P.with_issues() + f""" SELECT site_id, issue_ord, issue_id FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {P.SEQ}) AS issue_ord FROM issues) AS x WHERE issue_ord <= 10""")
def w2(spark, sf):
    return scores.head_issues(issues(spark, sf)).select("site_id", "issue_ord", "issue_id")


@query("w2_top_recommendations", P.with_issues(_RECS) + """ SELECT site_id, top_ord, rec_id FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY rec_ord) AS top_ord FROM recs) AS x WHERE top_ord <= 3""")
def w2_recs(spark, sf):
    return scores.top_recommendations(_recs(spark, sf)).select("site_id", "top_ord", "rec_id")


@query("e5_content_briefs", P.with_issues(P.FACTS, f"""g AS (
    SELECT site_id, count(*) FILTER (rule_id = 'R41') AS no_faq, count(*) FILTER (rule_id = 'R42') AS no_compare, count(*) FILTER (category = 'evidence') AS n_ev,
      count(*) FILTER (category = 'comparison') AS n_cmp, count(*) FILTER (rule_id = 'R44') AS n_thin FROM issues GROUP BY 1),
  t AS (SELECT site_id, list(title ORDER BY n) AS titles FROM (
    SELECT site_id, title, row_number() OVER (PARTITION BY site_id ORDER BY {P.SEQ}) AS n FROM issues WHERE category IN ('coverage', 'evidence')) AS x WHERE n <= 3 GROUP BY 1),
  ff AS (SELECT site_id, list(text ORDER BY fact_ord) AS told FROM facts GROUP BY 1),
  b AS (SELECT br.*, g.*  EXCLUDE (site_id), coalesce(t.titles, []) AS titles, coalesce(ff.told, []) AS told, coalesce(r.names, []) AS names
    FROM brands AS br LEFT JOIN g USING (site_id) LEFT JOIN t USING (site_id) LEFT JOIN ff USING (site_id) LEFT JOIN rivals AS r USING (site_id))""") + """
  SELECT site_id, 'faq-brief' AS brief_id, name || ' FAQ outline' AS title, coalesce(nullif(string_split(personas_s, '|')[1], ''), 'product and growth teams') AS audience,
    array_to_string(['Cover: ' || x FOR x IN titles], '|') AS covered, array_to_string(([name || ' is a ' || category || '.', one_liner] || told)[1:3], '|') AS claims,
    'Settle what buyers keep asking, each answer with a source.' AS angle, 'From each answer, lead on to prices, security and documents.' AS call_to_action FROM b WHERE no_faq > 0 OR n_ev > 0
  UNION ALL SELECT site_id, 'compare-brief', name || ' compare page outline', 'buyers evaluating alternatives', '', array_to_string([one_liner] || told[1:2], '|'),
    'Say plainly whom the product fits and whom it does not.', 'Close with the ways to read on, see prices or try it.' FROM b WHERE no_compare > 0 OR n_cmp > 0
  UNION ALL SELECT site_id, 'use-case-brief', name || ' use-case page outline', coalesce(nullif(string_split(personas_s, '|')[1], ''), 'teams evaluating tools'), '',
    array_to_string(([name || ' is a ' || category || '.', one_liner] || told)[1:3], '|'),
    'Show one job done, with results that can be cited.', 'Lead on to a first step for this very job.' FROM b WHERE n_thin > 0""")
def e5(spark, sf):
    missing = R.missing_page_types(features(spark, sf), sites(spark, sf))
    df = briefs.content_briefs(issues(spark, sf), missing, brands(spark, sf), facts(spark, sf), competitors(spark, sf))
    covered = F.array_join(F.filter("outline", lambda x: F.startswith(x, F.lit("Cover: "))), "|")
    return df.select("site_id", "brief_id", "title", "audience", covered.alias("covered"), joined("claims"), "angle", "call_to_action")


# ---- the whole audit, from stored files on -------------------------------------------------------

_AUDIT_PAGES = 10
_RANK = P.crawl_rank("lower(regexp_extract(url, '^[a-z]+://[^/]+([^?]*)', 1))")
_AUDITED = f"""all_pages AS ({D.SITE_PAGES}), {_LOCS}, {_REACHED},
targets AS (SELECT * FROM (SELECT site_id, url, {_RANK} AS r, row_number() OVER (PARTITION BY site_id ORDER BY {_RANK}, url) AS n FROM found) AS x WHERE n <= {_AUDIT_PAGES}),
planned AS (SELECT t.*, a.base_url, contains(coalesce(a.html, ''), 'http-equiv="refresh"') AND a.status = 200 AND a.url <> a.base_url || '/pricing' AS shim
  FROM targets AS t LEFT JOIN all_pages AS a USING (site_id, url)),
every AS (SELECT site_id, url, r, url AS src FROM planned WHERE NOT coalesce(shim, FALSE)
  UNION ALL SELECT site_id, base_url || '/pricing', r, url FROM planned WHERE shim),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, url ORDER BY r, src) AS n FROM every) AS x WHERE n = 1),
pages_d AS (
  SELECT coalesce(a.page_id, -1000000 - row_number() OVER (ORDER BY c.site_id, c.url)) AS page_id, a.k, coalesce(a.j, 12) AS j, c.site_id, s.base_url, c.url,
    coalesce(a.status, 404) AS status, CASE WHEN a.page_id IS NULL THEN 'No stored page' ELSE a.fetch_error END AS fetch_error,
    coalesce(a.html, '') AS html, coalesce(a.given, '') AS given
  FROM chosen AS c JOIN ({D.SITES}) AS s USING (site_id) LEFT JOIN all_pages AS a USING (site_id, url))"""


def _whole_audit(sql: str) -> str:
    """The audit's SQL over the pages that the plan leaves, with the planned urls as those found."""
    sql = sql.replace(f"pages_d AS ({D.SITE_PAGES})", _AUDITED)
    return sql.replace("coalesce(n_pages, 0) = 0", "NOT EXISTS (SELECT 1 FROM targets AS d WHERE d.site_id = sf.site_id)")


def _audit(spark, sf, part: str):
    def build():
        out = run_audit(
            D.site_pages(spark, sf), sites(spark, sf), D.derived(spark, sf, D.ROBOTS), brands(spark, sf), competitors(spark, sf),
            _sitemaps(spark, sf), max_pages=_AUDIT_PAGES,
        )
        return out[part]

    return shared(spark, sf, f"run-audit-{part}", build)


@query("run_audit_issues", _whole_audit(P.with_issues()) + f" SELECT issue_id, {_RULE_COLUMNS} FROM issues")
def audit_issues_of_files(spark, sf):
    return _audit(spark, sf, "issues").select("issue_id", "site_id", "rule_id", "severity", "title", "category", "bucket", "page_url")


@query("run_audit_summary", _whole_audit(P.with_issues(_SCORES)) + " " + _SUMMARY.format(
    vavr="CAST(NULL AS INTEGER) AS vavr", discovered="(SELECT count(*) FROM targets AS d WHERE d.site_id = s.site_id)"))
def audit_summary_of_files(spark, sf):
    return _audit(spark, sf, "audit_summary").withColumn("missing_page_types", joined("missing_page_types"))


@query("v5_index_candidates", P.with_sites("features") + """ SELECT site_id, url, page_type, page_type NOT IN ('home', 'product') AS is_key_candidate
    FROM f WHERE page_type <> 'other' AND fetch_error IS NULL AND status BETWEEN 200 AND 399""")
def v5(spark, sf):
    from citeframe.operators.search import index_candidates

    return index_candidates(features(spark, sf)).drop("reason")


@query("v5_index_candidate_counts", P.with_sites("features") + """ SELECT site_id, count(*) AS candidate_count, count(*) FILTER (page_type NOT IN ('home', 'product')) AS key_page_candidate_count
    FROM f WHERE page_type <> 'other' AND fetch_error IS NULL AND status BETWEEN 200 AND 399 GROUP BY 1""")
def v5_counts(spark, sf):
    from citeframe.operators.search import index_candidate_counts, index_candidates

    return index_candidate_counts(index_candidates(features(spark, sf)))


@query("s1_read_pages", f"SELECT regexp_extract(url, '://([^/]+)', 1) AS site_id, {GIVEN_URL} AS url, 200 AS status, 'text/html' AS content_type, html FROM pages")
def s1(spark, sf):
    return given_pages(spark, sf).drop("fetch_error")


@query("s1_page_status", f"SELECT url, status, CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || status END AS fetch_error FROM ({D.SITE_PAGES}) AS p")
def s1_status(spark, sf):
    return as_pages_raw(D.site_pages(spark, sf).drop("fetch_error")).select("url", "status", "fetch_error")
