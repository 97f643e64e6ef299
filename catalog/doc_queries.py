"""Text policy and link scans over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derive as D
from catalog.registry import query
from citeframe.operators import docscan as X

_NEG = (
    "(?i)\\?$|\\bdoes\\b.{0,80}\\bscrape\\b|\\b(block or rewrite|what to block|claims or implies|must not imply)\\b"
    "|\\b(no|not|does not|do not|without|avoid|avoids|avoiding|block|reject|forbid|non-goal|non-goals|is not|must not|should not|cannot|can''t|rather than|instead of|vs|versus"
    "|hard requirement|out of scope|should not change)\\b|不承诺|不会|不要|不能|禁止|不是|避免|非目标|无消费级|不抓取"
)
_RULES = {
    "overclaim-ranking": "(?i)(guarantee|promise|ensure|assure).{0,80}(rank|ranking|placement|traffic|visibility)|#1([^0-9].{0,39})?(rank|ranking)|number one.{0,40}(rank|ranking)"
    "|\\b[0-9]{1,3}%(\\b).{0,60}(lift|increase|improvement|traffic|ranking|visibility)|排名.{0,20}(保证|承诺|提升)|提升.{0,20}[0-9]{1,3}%",
    "consumer-ui-scraping": "(?i)(consumer AI UI scraping|consumer UI scraping|scrape consumer AI|抓取消费级 AI|抓取消费级 UI)",
    "fake-proof": "(?i)\\b(aggregateRating|reviewRating|ratingValue|downloadCount)\\b|\\b(testimonial|customer logo|customer proof|download count|star count)\\b|客户案例|客户背书|下载量|星标数",
}
_LINES = f"""docs AS ({D.DOCUMENTS}), split AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM docs),
lines AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM split),
t AS (SELECT *, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS tl FROM lines)"""
_HITS = " UNION ALL ".join(
    [f"SELECT doc_id, ls, line, line_no, tl, '{rule}' AS rule FROM t WHERE regexp_matches(tl, '{pattern}')" for rule, pattern in _RULES.items()]
    + ["SELECT doc_id, ls, line, line_no, tl, 'robots-host-claim' AS rule FROM t WHERE regexp_matches(tl, '(?i)robots\\.txt') "
       "AND regexp_matches(tl, '(?i)(host-level|host-wide|whole host|controls the host|控制整个|控制 host)')"]
)


def _docs(spark, sf):
    return D.derived(spark, sf, D.DOCUMENTS)


@query("x1_scan_policies", f"""WITH {_LINES}, hits AS ({_HITS})
  SELECT doc_id, line_no, rule FROM hits WHERE NOT regexp_matches(tl, '{_NEG}') AND NOT regexp_matches(array_to_string(ls[greatest(1, line_no - 5):line_no], ' '), '{_NEG}')""")
def x1(spark, sf):
    return X.scan_policies(_docs(spark, sf)).filter(F.col("rule") != "local-absolute-path").select("doc_id", "line_no", "rule")


# every line of the given texts with a frequent word, unless a line shortly before ends in a comma
_WORD = X.Policy("frequent-word", ("(?<![A-Za-z0-9_])(the|der|la|password|license)(?![A-Za-z0-9_])",))


@query("x1_scan_given_texts", """WITH split AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents),
  lines AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM split)
  SELECT doc_id, line_no, 'frequent-word' AS rule FROM lines WHERE regexp_matches(line, '(?i)\\b(the|der|la|password|license)\\b')
    AND NOT regexp_matches(array_to_string(ls[greatest(1, line_no - 5):line_no], ' '), '(?i)\\bnot\\b|éa')""")
def x1_given(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    return X.scan_policies(docs, policies=(_WORD,), negation="(?<![A-Za-z0-9_])not(?![A-Za-z0-9_])|éa").select("doc_id", "line_no", "rule")


@query("x2_scan_blocks", f"""WITH {_LINES} SELECT doc_id, line_no FROM t WHERE contains(line, 'upload-artifact')
    AND regexp_matches(array_to_string(ls[line_no:line_no + 17], chr(10)), 'runs/[A-Za-z0-9]+') AND NOT contains(array_to_string(ls[line_no:line_no + 17], chr(10)), '!runs/raw/')""")
def x2(spark, sf):
    return X.scan_blocks(_docs(spark, sf), "upload-artifact", "(?<![A-Za-z0-9_])runs/[A-Za-z0-9]+", "!\\s*.+/raw/\\*\\*").select("doc_id", "line_no")


@query("x3_local_paths", f"""WITH {_LINES} SELECT doc_id, line_no FROM t WHERE regexp_matches(line, '(^|[\\s(''"=<])(file:///|/?[A-Za-z]:[\\\\/])')""")
def x3(spark, sf):
    return X.scan_policies(_docs(spark, sf)).filter(F.col("rule") == "local-absolute-path").select("doc_id", "line_no")


_FILES = f"""files AS ({D.DOC_FILES}), lines AS (SELECT path, doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line,
    generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line_no FROM files),
heads AS (SELECT path, line_no, regexp_extract(line, '^#{{1,6}}\\s+(.+?)\\s*#*\\s*$', 1) AS h FROM lines WHERE regexp_matches(line, '^#{{1,6}}\\s+(.+?)\\s*#*\\s*$')),
slugs AS (SELECT path, line_no, regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(h), '<[^>]*>', '', 'g'), '`([^`]*)`', '\\1', 'g')), '[^\\p{{L}}\\p{{N}}\\s-]', '', 'g')), '\\s+', '-', 'g') AS slug FROM heads),
anchors AS (SELECT path, line_no, slug || CASE WHEN n = 1 THEN '' ELSE '-' || (n - 1) END AS anchor FROM (
  SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY line_no) AS n FROM slugs WHERE slug <> '') AS x)"""


def _files(spark, sf):
    return D.derived(spark, sf, D.DOC_FILES).select("path", "text")


@query("x4_heading_anchors", f"WITH {_FILES} SELECT path, line_no, anchor FROM anchors")
def x4(spark, sf):
    return X.heading_anchors(_files(spark, sf)).select("path", "line_no", "anchor")


@query("x5_doc_link_findings", f"""WITH {_FILES}, g AS (SELECT path, doc_id, regexp_replace(path, '[^/]*$', '') AS dir FROM files),
  nxt AS (SELECT g.path, 'd' || (doc_id + 1) || '.md#intro-part' AS href, dir || 'd' || (doc_id + 1) || '.md' AS target FROM g)
  SELECT path, href, 'target-missing' AS rule FROM nxt WHERE target NOT IN (SELECT path FROM files)
  UNION ALL SELECT path, '../img/a b.png', 'target-missing' FROM g
  UNION ALL SELECT path, '../../../out.md', 'outside-root' FROM g WHERE doc_id % 5 = 0
  UNION ALL SELECT path, '%zz.md', 'undecodable' FROM g WHERE doc_id % 5 = 1
  UNION ALL SELECT path, './d' || doc_id || '.md#no-such-part', 'anchor-missing' FROM g WHERE doc_id % 5 = 2""")
def x5(spark, sf):
    return X.doc_link_findings(_files(spark, sf)).select("path", "href", "rule")
