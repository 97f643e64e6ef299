"""Readers, payload normalisation, run history and writers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from catalog import derive as D
from catalog import sql_parts as P
from catalog.answer_queries import _BASE, _scored
from catalog.registry import ORACLES, features, issues, joined, query, sites
from catalog.search_queries import _cover, _matched, _WITH
from catalog.site_queries import _audit_summary, _recs
from citeframe.operators import scores
from citeframe.operators.search import index_candidates
from citeframe.session import shared_dir
from citeframe.sources import answers as IMPORT
from citeframe.sources import sinks
from citeframe.sources.dimensions import validate
from citeframe.sources.runs import list_runs, read_runs
from citeframe.sources.search_csv import check_search_rows, read_search_csv
from citeframe.sources.site_files import parse_robots


def _folder(spark, name: str) -> str:
    return os.path.join(shared_dir(spark), "citeframe-queries", f"{name}-{uuid.uuid4().hex}")


# ---- robots -----------------------------------------------------------------------------------

_ROBOTS = f"r AS (SELECT site_id, text, CAST(replace(site_id, 'site-', '') AS BIGINT) AS k FROM ({D.ROBOTS}) AS x)"


@query("s2_robots", f"""WITH {_ROBOTS} SELECT site_id, text IS NOT NULL AS "exists", k % 5 = 2 AS blocked_all, CASE WHEN k % 5 IN (3, 4) THEN 'PerplexityBot' ELSE '' END AS blocked_bots,
    CASE WHEN k % 5 = 1 THEN 'https://s' || k || '.example.com/sitemap-extra.xml' ELSE '' END AS sitemap_hints FROM r""")
def s2(spark, sf):
    df = parse_robots(D.derived(spark, sf, D.ROBOTS))[0]
    return df.select("site_id", "exists", "blocked_all", joined("blocked_bots"), joined("sitemap_hints"))


@query("s2_robots_rules", f"""WITH {_ROBOTS}
  SELECT site_id, '*' AS agent, 'sitemap' AS directive, 'https://s' || k || '.example.com/sitemap-extra.xml' AS value, 3 AS line_no FROM r WHERE k % 5 = 1
  UNION ALL SELECT site_id, '*', 'disallow', '/', 2 FROM r WHERE k % 5 = 2 UNION ALL SELECT site_id, 'PerplexityBot', 'disallow', '/', 3 FROM r WHERE k % 5 = 3
  UNION ALL SELECT site_id, 'PerplexityBot', 'disallow', '/', 2 FROM r WHERE k % 5 = 4 UNION ALL SELECT site_id, '*', 'disallow', '/private', 4 FROM r WHERE k % 5 = 4""")
def s2_rules(spark, sf):
    return parse_robots(D.derived(spark, sf, D.ROBOTS))[1]


# ---- dimensions -------------------------------------------------------------------------------

_FLAWED = f"""SELECT * REPLACE (CASE WHEN k % 3 = 1 THEN '' ELSE name END AS name, CASE WHEN k % 4 = 3 THEN NULL ELSE domain END AS domain) FROM (
    SELECT *, CAST(replace(site_id, 'site-', '') AS BIGINT) AS k FROM ({D.BRANDS}) AS b) AS x"""


def _flawed(spark, sf):
    k = F.replace("site_id", F.lit("site-"), F.lit("")).cast("long")
    df = D.brands_of(spark, sf, D.BRANDS).withColumn("personas", F.when(k % 2 == 0, F.col("personas")))
    return df.withColumns({"name": F.when(k % 3 == 1, "").otherwise(F.col("name")), "domain": F.when(k % 4 != 3, F.col("domain"))})


@query("s4_dimensions", f"""SELECT site_id, name, domain, category, CASE WHEN k % 2 = 0 THEN replace(personas_s, '|', ';') ELSE '' END AS personas FROM ({_FLAWED}) AS x WHERE name <> '' AND domain IS NOT NULL""")
def s4(spark, sf):
    good, _ = validate(_flawed(spark, sf), "brands")
    return good.select("site_id", "name", "domain", "category", joined("personas", ";"))


@query("s4_dimension_rejects", f"""SELECT site_id, concat_ws('; ', CASE WHEN name = '' THEN 'name: must not be empty' END, CASE WHEN domain IS NULL THEN 'domain: must not be empty' END) AS errors
    FROM ({_FLAWED}) AS x WHERE name = '' OR domain IS NULL""")
def s4_rejects(spark, sf):
    return validate(_flawed(spark, sf), "brands")[1].select("site_id", joined("errors", "; "))


# ---- search export ----------------------------------------------------------------------------

_CSV = f"""SELECT site_id, source, row_no,
    CASE WHEN row_no % 97 = 96 THEN '' WHEN row_no % 89 = 88 THEN 'no url' ELSE page || CASE WHEN row_no % 11 = 3 THEN '?q="a,b"' ELSE '' END END AS page,
    CASE WHEN row_no % 83 = 82 THEN '-1' WHEN row_no % 5 = 4 THEN '' ELSE CAST(CAST(clicks AS INT) AS STRING) END AS clicks,
    CASE WHEN row_no % 79 = 78 THEN 'many' ELSE CAST(CAST(impressions AS INT) AS STRING) END AS impressions,
    CASE WHEN row_no % 73 = 72 THEN 'NaN' ELSE CAST(CAST(floor(ctr) AS INT) AS STRING) || '.5%' END AS ctr, CAST(CAST(floor(position) AS INT) AS STRING) AS position
    FROM ({D.SEARCH_ROWS}) AS s"""
_REASON = """CASE WHEN page = '' THEN 'page is missing' WHEN page = 'no url' THEN 'page is no url' WHEN clicks = '-1' THEN 'clicks is no number of 0 or more'
    WHEN impressions = 'many' THEN 'impressions is no number of 0 or more' WHEN ctr = 'NaN' THEN 'ctr is no number of 0 or more' END"""


@query("s5_search_rows", f"""SELECT site_id, source, row_no, page, CAST(CASE WHEN clicks = '' THEN '0' ELSE clicks END AS DOUBLE) AS clicks, CAST(impressions AS DOUBLE) AS impressions,
    CAST(replace(ctr, '%', '') AS DOUBLE) AS ctr, CAST(position AS DOUBLE) AS position FROM ({_CSV}) AS x WHERE {_REASON} IS NULL""")
def s5(spark, sf):
    return check_search_rows(D.derived(spark, sf, _CSV))[0]


@query("s5_search_rejects", f"SELECT row_no, {_REASON} AS reason FROM ({_CSV}) AS x WHERE {_REASON} IS NOT NULL")
def s5_rejects(spark, sf):
    return check_search_rows(D.derived(spark, sf, _CSV))[1].select("row_no", "reason")


@query("s5_read_search_csv", f"""SELECT 'all' AS site_id, page, CAST(CASE WHEN clicks = '' THEN '0' ELSE clicks END AS DOUBLE) AS clicks, CAST(impressions AS DOUBLE) AS impressions
    FROM ({_CSV}) AS x WHERE {_REASON} IS NULL""")
def s5_csv(spark, sf):
    path = _folder(spark, "search-csv")
    raw = D.derived(spark, sf, _CSV).select(
        F.col("position").alias(" Position"), F.col("page").alias("PAGE"), F.col("ctr").alias("CTR"), "clicks", F.col("impressions").alias("Impressions"),
        # a quoted field with line breaks, quotes and what looks like a record of its own
        F.when(F.col("row_no") % 3 == 0, F.concat(F.lit('said "no",\n1,https://a.example.com,2,3,4\n'), F.col("page"))).alias("note"),
    )
    raw.write.csv(path, header=True, escape='"')
    good, _ = read_search_csv(spark, path, "all", "search-console")
    return good.select("site_id", "page", "clicks", "impressions")


# ---- answer import and payloads -----------------------------------------------------------------

_CLEAN = "replace(replace(replace(replace(replace(text, '\"', ''), chr(92), ''), chr(10), ' '), chr(13), ' '), chr(9), ' ')"
_TURNS = f"SELECT conv_id, turn, role, {_CLEAN} AS t FROM conversations"
_DOCS = f"""SELECT 'site-' || CAST(conv_id % 9 AS STRING) AS site_id, 'run-' || CAST(turn AS STRING) AS run_id, conv_id,
  CASE WHEN conv_id % 13 = 12 THEN 'broken' ELSE
    CASE WHEN conv_id % 2 = 0 THEN '{{"provider":"wrapped","locale":"de","runCount":3,"responses":[' ELSE '[' END
    || '{{"promptId":' || CASE WHEN conv_id % 7 = 6 THEN 'null' ELSE '"p' || CAST(conv_id AS STRING) || '"' END || ',"answerText":"' || t || '"'
    || CASE WHEN conv_id % 3 = 1 THEN ',"provider":"own","model":"m1","sampleIndex":2' ELSE '' END
    || CASE conv_id % 5 WHEN 1 THEN ',"rankPosition":3' WHEN 2 THEN ',"rankPosition":1.5' WHEN 3 THEN ',"rankPosition":null' ELSE '' END
    || ',"citations":["https://a.example.com/x",{{"url":' || CASE WHEN conv_id % 11 = 10 THEN '""' ELSE '"https://b.example.com"' END || ',"title":"B","owned":true}}]}},{{"promptId":"second","answerText":5}}'
    || CASE WHEN conv_id % 2 = 0 THEN ']}}' ELSE ']' END END AS doc,
  t FROM ({_TURNS}) AS c WHERE role = 'assistant'"""


_DOCS2 = f"""SELECT conv_id, turn, t, '{{"promptId":"line-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || '","answerText":"' || t || '"}}' AS doc
  FROM ({_TURNS}) AS c WHERE role = 'user'"""


@query("s6_import_answers", f"""SELECT site_id, run_id, 'p' || conv_id AS prompt_id, t AS answer_text,
    CASE WHEN conv_id % 3 = 1 THEN 'own' WHEN conv_id % 2 = 0 THEN 'wrapped' ELSE 'manual' END AS provider, CASE WHEN conv_id % 3 = 1 THEN 'm1' ELSE 'manual-import' END AS model,
    CASE WHEN conv_id % 3 = 1 THEN 2 ELSE 0 END AS sample_index, CASE WHEN conv_id % 2 = 0 THEN 'de' ELSE 'en' END AS locale, CASE WHEN conv_id % 5 = 1 THEN 3 END AS rank_position,
    CASE WHEN conv_id % 2 = 0 THEN 3 ELSE 1 END AS run_count, 'https://a.example.com/x|https://b.example.com' AS urls
  FROM ({_DOCS}) AS d WHERE conv_id % 13 <> 12 AND conv_id % 7 <> 6 AND conv_id % 5 <> 2 AND conv_id % 11 <> 10""")
def s6(spark, sf):
    good, _ = IMPORT.import_answers(D.derived(spark, sf, _DOCS).select("site_id", "run_id", "doc"), locale="en")
    return good.select("site_id", "run_id", "prompt_id", "answer_text", "provider", "model", "sample_index", "locale", "rank_position", "run_count",
                       F.array_join("citations.url", "|").alias("urls"))


@query("s6_answer_lines", f"""SELECT 'all' AS site_id, 'p' || conv_id AS prompt_id, t AS answer_text,
    CASE WHEN conv_id % 3 = 1 THEN 'own' WHEN conv_id % 2 = 0 THEN 'wrapped' ELSE 'manual' END AS provider, CASE WHEN conv_id % 2 = 0 THEN 'de' ELSE 'en' END AS locale
  FROM ({_DOCS}) AS d WHERE conv_id % 13 <> 12 AND conv_id % 7 <> 6 AND conv_id % 5 <> 2 AND conv_id % 11 <> 10
  UNION ALL SELECT 'all', 'line-' || conv_id || '-' || turn, t, 'manual', 'en' FROM ({_DOCS2}) AS e""")
def s6_lines(spark, sf):
    path = _folder(spark, "answer-lines")
    D.derived(spark, sf, _DOCS).select("doc").union(D.derived(spark, sf, _DOCS2).select("doc")).write.text(path)
    good, _ = IMPORT.read_answers(spark, path, "all", "r1", locale="en", lines=True)
    return good.select("site_id", "prompt_id", "answer_text", "provider", "locale")


@query("s6_import_rejects", f"""SELECT site_id, run_id, CASE WHEN conv_id % 13 = 12 OR conv_id % 7 = 6 THEN NULL ELSE 'p' || conv_id END AS prompt_id,
    CASE WHEN conv_id % 13 = 12 THEN 'no array of responses' WHEN conv_id % 7 = 6 THEN 'promptId is missing' WHEN conv_id % 11 = 10 THEN 'a citation has no url' ELSE 'rankPosition is no positive integer' END AS reason
  FROM ({_DOCS}) AS d WHERE conv_id % 13 = 12 OR conv_id % 7 = 6 OR conv_id % 5 = 2 OR conv_id % 11 = 10
  UNION ALL SELECT site_id, run_id, 'second', 'answerText is missing' FROM ({_DOCS}) AS d WHERE conv_id % 13 <> 12""")
def s6_rejects(spark, sf):
    _, bad = IMPORT.import_answers(D.derived(spark, sf, _DOCS).select("site_id", "run_id", "doc"), locale="en")
    return bad.select("site_id", "run_id", "prompt_id", "reason")


_KEYS = "'site-' || CAST(conv_id % 9 AS STRING) AS site_id, 'run-' || CAST(turn AS STRING) AS run_id, 'p' || CAST(conv_id AS STRING) AS prompt_id, CAST(0 AS INT) AS sample_index"
_A = f"""SELECT {_KEYS}, 'a' AS provider, conv_id, t,
  '{{"output":[{{"type":"web_search_call","action":{{"sources":[{{"url":"https://x.example.com","title":"X","published_at":"2024"}},{{"url":"https://x.example.com","title":"again"}},{{"url":"https://y.example.com/'
  || CAST(conv_id AS STRING) || '","date":"2023","snippet":"s"}}]}}}},{{"type":"message","content":[{{"text":"' || t || '","annotations":[{{"type":"url_citation","url":"https://x.example.com","title":"first"}},{{"type":"url_citation","url":"https://x.example.com","title":"second"}},{{"type":"note","url":"https://n"}},{{"type":"url_citation","url":""}}]}},{{"text":"end "}}]}}]'
  || CASE WHEN conv_id % 3 = 0 THEN ',"output_text":"direct"' ELSE '' END || '}}' AS payload FROM ({_TURNS}) AS c WHERE role = 'assistant'"""
_B = f"""SELECT {_KEYS}, 'b' AS provider, conv_id, t,
  '{{"choices":[{{"message":{{"content":"  ' || t || ' "}}}}],"citations":["https://r1.example.com","https://r2.example.com","https://r1.example.com",7],"search_results":[{{"url":"https://r1.example.com","title":"old"}},'
  || '{{"url":"https://r1.example.com","title":"new","last_updated":"2024","source":"news"}},{{"title":"none"}}]}}' AS payload FROM ({_TURNS}) AS c WHERE role = 'user'"""


@query("s7_payload_answers", f"SELECT site_id, run_id, prompt_id, CASE WHEN conv_id % 3 = 0 THEN 'direct' ELSE trim(t || chr(10) || chr(10) || 'end ') END AS answer_text, 'https://x.example.com' AS urls, 'first' AS titles FROM ({_A}) AS a")
def s7(spark, sf):
    got, _, _ = IMPORT.normalize_payloads_a(D.derived(spark, sf, _A).drop("conv_id", "t"))
    return got.select("site_id", "run_id", "prompt_id", "answer_text", F.array_join("citations.url", "|").alias("urls"), F.array_join("citations.title", "|").alias("titles"))


@query("s7_payload_sources", f"""SELECT run_id, prompt_id, 'https://x.example.com' AS url, 'X' AS title, '2024' AS date, CAST(NULL AS VARCHAR) AS snippet FROM ({_A}) AS a
    UNION ALL SELECT run_id, prompt_id, 'https://y.example.com/' || conv_id, NULL, '2023', 's' FROM ({_A}) AS a""")
def s7_sources(spark, sf):
    _, _, sources = IMPORT.normalize_payloads_a(D.derived(spark, sf, _A).drop("conv_id", "t"))
    return sources.select("run_id", "prompt_id", "url", "title", "date", "snippet")


@query("s8_payload_citations", f"""SELECT run_id, prompt_id, 0 AS cit_ord, 'https://r1.example.com' AS url, 'new' AS title FROM ({_B}) AS b
    UNION ALL SELECT run_id, prompt_id, 1, 'https://r2.example.com', NULL FROM ({_B}) AS b""")
def s8(spark, sf):
    _, citations, _ = IMPORT.normalize_payloads_b(D.derived(spark, sf, _B).drop("conv_id", "t"))
    return citations.select("run_id", "prompt_id", "cit_ord", "url", "title")


@query("s8_payload_answers", f"SELECT run_id, prompt_id, trim(t) AS answer_text, 2 AS n_citations FROM ({_B}) AS b")
def s8_answers(spark, sf):
    got, _, _ = IMPORT.normalize_payloads_b(D.derived(spark, sf, _B).drop("conv_id", "t"))
    return got.select("run_id", "prompt_id", "answer_text", F.size("citations").alias("n_citations"))


# ---- run history --------------------------------------------------------------------------------

_RUN = "SELECT DISTINCT conv_id FROM conversations"
_MANIFEST = f"""SELECT 'run-' || CAST(conv_id AS STRING) AS run_id, CASE WHEN conv_id % 6 = 5 THEN '{{' ELSE
    '{{"kind":"' || CASE WHEN conv_id % 2 = 0 THEN 'audit' ELSE 'eval' END || '","generatedAt":"2024-01-' || CAST(10 + conv_id % 20 AS STRING) || 'T00:00:00Z","site":{{"input":"in-' || CAST(conv_id AS STRING)
    || '","baseUrl":"https://b.example.com"' || CASE WHEN conv_id % 3 = 0 THEN ',"display":"Shown"' ELSE '' END || '}},"summary":{{' || CASE WHEN conv_id % 4 = 0 THEN '"overallScore":' || CAST(conv_id % 100 AS STRING) ELSE '"overallScore":null' END
    || '}},"artifacts":["a","b"]}}' END AS doc, conv_id FROM ({_RUN}) AS r"""
_SHARE = f"""SELECT 'run-' || CAST(conv_id AS STRING) AS run_id, '{{"metrics":{{"overallScore":77,"vavr":' || CAST(conv_id % 50 AS STRING) || '}}}}' AS doc FROM ({_RUN}) AS r WHERE conv_id % 5 <> 1"""


@query("s9_list_runs", f"""SELECT run_id, CASE WHEN conv_id % 2 = 0 THEN 'audit' ELSE 'eval' END AS kind, '2024-01-' || (10 + conv_id % 20) || 'T00:00:00Z' AS generated_at,
    CASE WHEN conv_id % 3 = 0 THEN 'Shown' ELSE 'https://b.example.com' END AS site_label, CASE WHEN conv_id % 4 = 0 THEN conv_id % 100 WHEN conv_id % 5 <> 1 THEN 77 END::DOUBLE AS overall_score,
    CASE WHEN conv_id % 5 <> 1 THEN conv_id % 50 END::DOUBLE AS vavr, 2 AS artifact_count FROM ({_MANIFEST}) AS m WHERE conv_id % 6 <> 5""")
def s9_list(spark, sf):
    return list_runs(D.derived(spark, sf, _MANIFEST).drop("conv_id"), D.derived(spark, sf, _SHARE)).drop("site_input")


# ---- writers: written twice, broken once, read back ----------------------------------------------

_AT = "2024-05-01T00:00:00Z"
_AUDIT_TABLES = {
    "pages": ("url", "page_type"), "issues": ("issue_id", "severity"), "bucket_scores": ("bucket", "score"), "audit_summary": ("overall_score", "crawled_pages"),
    "recommendations": ("rec_id", "issue_count"), "recommendation_issues": ("rec_id", "issue_id"), "top_issues": ("title", "top_ord"), "top_recommendations": ("rec_id", "top_ord"),
}


def _back(spark, root, tables):
    """Rows of all written tables as (written, run_id, site_id, row_key, detail)."""
    out = None
    for name, (key, detail) in tables.items():
        df = sinks.read_committed(spark, root, name)
        df = df.select(F.lit(name).alias("written"), "run_id", "site_id", F.col(key).cast("string").alias("row_key"), F.col(detail).cast("string").alias("detail"))
        out = df if out is None else out.unionByName(df)
    return out


class _Broken(Exception):
    pass


def _break_a_write(root: str, tables) -> None:
    """A write that stops after its first table, as when a driver is lost."""

    class Stops(dict):
        def items(self):
            yield next(iter(super().items()))
            raise _Broken

    try:
        sinks.write_run(root, "r1", "audit", Stops(tables))
    except _Broken:
        pass


def _audit_root(spark, sf) -> str:
    root = _folder(spark, "audit")
    buckets = scores.bucket_scores(issues(spark, sf), sites(spark, sf))
    recs = _recs(spark, sf)
    tables = {
        "pages": features(spark, sf), "issues": issues(spark, sf), "bucket_scores": buckets, "audit_summary": _audit_summary(spark, sf), "recommendations": recs,
        "recommendation_issues": scores.recommendation_issues(issues(spark, sf)), "top_issues": scores.top_issues(issues(spark, sf)),
        "top_recommendations": scores.top_recommendations(recs),
    }
    for _ in range(2):
        sinks.write_audit(tables, sites(spark, sf), root, "r1", _AT)
    _break_a_write(root, tables)
    return root


_K1_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS written, 'r1' AS run_id, site_id, CAST({key} AS VARCHAR) AS row_key, CAST({detail} AS VARCHAR) AS detail FROM ({sql})"
    for (name, (key, detail)), sql in zip(
        _AUDIT_TABLES.items(),
        [P.with_sites("features") + " SELECT * FROM f", ORACLES["r_audit_issues"], ORACLES["a1_bucket_scores"], ORACLES["a3_audit_summary"], ORACLES["a4_recommendations"],
         ORACLES["a4_recommendation_issues"], ORACLES["w1_top_issues"], ORACLES["w2_top_recommendations"]],
        strict=True,
    )
)


@query("k1_write_audit", _K1_SQL)
def k1(spark, sf):
    return _back(spark, _audit_root(spark, sf), _AUDIT_TABLES)


@query("s9_read_runs", f"""SELECT 'r1/' || site_id AS run_id, 'audit' AS kind, '{_AT}' AS generated_at, base_url AS site_label, site_id AS site_input,
    overall_score::DOUBLE AS overall_score, vavr::DOUBLE AS vavr, {len(_AUDIT_TABLES)} AS artifact_count FROM ({ORACLES["a3_audit_summary"]}) AS a JOIN ({D.SITES}) AS s USING (site_id)""")
def s9(spark, sf):
    return read_runs(spark, _audit_root(spark, sf))


@query("k2_write_eval", _BASE + """ SELECT 'raw_payloads' AS written, run_id, provider, provider || '/' || prompt_id || CASE WHEN sample_index > 0 THEN '--sample-' || (sample_index + 1) ELSE '' END || '.json' AS row_key,
    answer_text AS detail FROM s UNION ALL SELECT 'answer_scores', run_id, provider, prompt_id || '/' || sample_index, locale FROM s""")
def k2(spark, sf):
    root = _folder(spark, "eval")
    scored = _scored(spark, sf)
    tables = {"answer_scores": scored, "raw_payloads": scored.withColumn("raw_payload", F.col("answer_text"))}
    for run_id in ("run-0", "run-1", "run-0"):
        sinks.write_eval(tables, sites(spark, sf), root, run_id, _AT)
    raw = sinks.read_committed(spark, root, "raw_payloads", "json")
    raw = raw.select(F.lit("raw_payloads").alias("written"), "run_id", "provider", F.col("raw_payload_file").alias("row_key"), F.col("raw_payload").alias("detail"))
    kept = sinks.read_committed(spark, root, "answer_scores")
    key = F.concat_ws("/", "prompt_id", F.col("sample_index").cast("string")).alias("row_key")
    return raw.unionByName(kept.select(F.lit("answer_scores").alias("written"), "run_id", "provider", key, F.col("locale").alias("detail")))


_VALIDATION_TABLES = {"search_pages": ("search_key", "source"), "key_page_coverage": ("page_url", "impressions"), "index_candidates": ("url", "page_type")}


@query("k3_write_validation", f"""SELECT 'key_page_coverage' AS written, 'v1' AS run_id, site_id, page_url AS row_key, CAST(impressions AS VARCHAR) AS detail FROM ({_WITH} SELECT * FROM cover)
    UNION ALL SELECT 'index_candidates', 'v1', site_id, url, page_type FROM ({ORACLES["v5_index_candidates"]})
    UNION ALL SELECT 'search_pages', 'v1', site_id, search_key, source FROM ({ORACLES["j4_match_search_pages"]})""")
def k3(spark, sf):
    root = _folder(spark, "validation")
    tables = {"search_pages": _matched(spark, sf), "key_page_coverage": _cover(spark, sf), "index_candidates": index_candidates(features(spark, sf))}
    for _ in range(2):
        sinks.write_validation(tables, root, "v1")
    return _back(spark, root, _VALIDATION_TABLES)
