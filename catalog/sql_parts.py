"""SQL building blocks of the oracle queries (DuckDB)."""

from __future__ import annotations

from catalog import derive as D
from citeframe import constants as C


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def unescape(x: str) -> str:
    for code, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{code}', '{char}')"
    return x


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def cut(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE trim(substring({x}, 1, {n - 3})) || '...' END)"


def clean(x: str, n: int) -> str:
    s = squash(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    return cut(s, n)


def body_text(html: str) -> str:
    """Visible text: what follows the body tag, without scripts, comments and tags."""
    x = f"regexp_extract({html}, '<body>(.*)$', 1, 's')"
    x = f"regexp_replace({x}, '<script.*?</script>', '', 'gs')"
    x = f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"
    return squash(unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: length(w) >= 4))"


def coverage(text: str, expected: str) -> str:
    t = tokens(expected)
    hits = f"len(list_filter({t}, lambda w: contains(lower({text}), w)))"
    return f"(CASE WHEN len({t}) = 0 THEN 1.0 ELSE {hits}::DOUBLE / len({t}) END)"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def words(x: str) -> str:
    latin = f"len(regexp_extract_all({x}, '[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*'))"
    cjk = f"len(regexp_extract_all({x}, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]'))"
    return f"CAST({latin} + ceil({cjk} / 2) AS INTEGER)"


def firsts(values: str, n: int = 3) -> str:
    """First n distinct trimmed values of a list, in order."""
    t = f"list_transform({values}, lambda v: trim(v))"
    return f"list_filter({t}, lambda v, i: list_position({t}, v) = i)[1:{n}]"


def page_type(path: str, title: str, h1: str, base: str = "'/'") -> str:
    hay = f"lower({title} || ' ' || {h1} || ' ' || {path})"
    out = f"CASE WHEN {path} IN ('/', '/en', '/zh', '/zh-cn', {base}) THEN 'home'"
    for name, in_path, in_text in C.PAGE_TYPE_WORDS:
        tests = [f"contains({path}, '{w}')" for w in in_path] + [f"contains({hay}, '{w}')" for w in in_text]
        out += f" WHEN {' OR '.join(tests)} THEN '{name}'"
    return out + " ELSE 'other' END"


def encoded(x: str) -> str:
    out = f"url_encode({x})"
    for code, char in (("%2F", "/"), ("%2C", ","), ("%3A", ":"), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "\'\'"), ("%28", "("),
                       ("%29", ")"), ("%2A", "*"), ("%2B", "+"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%7E", "~"), ("%25", "%")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


def crawl_rank(path: str) -> str:
    found = {t: w for t, w, _ in C.PAGE_TYPE_WORDS}
    out = f"CASE WHEN {path} = '/' THEN 0"
    for i, name in enumerate(C.CRAWL_ORDER_TYPES, start=1):
        out += f" WHEN {' OR '.join(f'contains({path}, {chr(39)}{w}{chr(39)})' for w in found[name])} THEN {i}"
    return out + " ELSE 9 END"


# ---- features of the derived sites -------------------------------------------------------

_PARTS = f"""
parts AS (
  SELECT page_id, k, j, site_id, base_url, url, status, fetch_error, html, given,
    substring(url, length(base_url) + 1) AS path,
    trim({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
    regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS meta_description,
    trim({unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS h1,
    trim({unescape("regexp_extract(html, '<h[123]>([^<]*)</h[123]>', 1)")}) AS first_heading,
    len(regexp_extract_all(html, '<h1>')) AS h1_count,
    regexp_extract_all(html, '<h[23]>([^<]*)</h[23]>', 1) AS headings,
    len(regexp_extract_all(html, '<(ul|ol)>')) AS lists,
    len(regexp_extract_all(html, '<table>')) AS n_tables,
    len(regexp_extract_all(html, '<script')) AS scripts,
    contains(html, 'NOINDEX') AS noindex,
    len(regexp_extract_all(html, '<(button|input)')) AS controls,
    len(regexp_extract_all(html, '<(button|input)[^>]*aria-label')) AS aria_controls,
    {body_text('html')} AS body_text,
    regexp_extract(html, '<script type="application/ld\\+json">(.*?)</script>', 1) AS ld
  FROM pages_d)"""

_NUM = "(?i)(?:\\$\\s?\\d{1,4}(?:[.,]\\d+)?|\\b\\d{1,4}(?:[.,]\\d+)?%?(?:\\s?(?:k|m|b|days?|weeks?|months?|users?|seats?))?\\b)"
_DAY = "(?i)\\b(?:20\\d{2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\b"
_VER = "(?i)\\bv?\\d+\\.\\d+(?:\\.\\d+)?\\b"


def _terms(values) -> str:
    return f"list_filter({text_list(values)}, lambda w: contains(lower(body_text), w))"


_FEATURES = f"""
feats AS (
  SELECT *, {words('body_text')} AS word_count, substring(body_text, 1, 240) AS snippet,
    {page_type('path', 'title', 'h1')} AS page_type, {crawl_rank('path')} AS page_rank,
    fetch_error IS NULL AND status <> 0 AS is_ok,
    trim(concat_ws(' ', title, meta_description, h1, array_to_string(headings, ' '), substring(body_text, 1, 240))) AS page_text
  FROM parts),
f0 AS (SELECT *, page_type <> 'other' AS is_key FROM feats),
ev AS (
  SELECT page_id, u.signal AS signal, u.examples AS examples, u.n AS n FROM (
    SELECT page_id, unnest([
      {{'signal': 'numbers', 'examples': {firsts(f"regexp_extract_all(body_text, '{_NUM}')")}, 'n': -1}},
      {{'signal': 'tables', 'examples': [n_tables || ' table' || CASE WHEN n_tables = 1 THEN '' ELSE 's' END], 'n': n_tables}},
      {{'signal': 'lists', 'examples': [lists || ' list' || CASE WHEN lists = 1 THEN '' ELSE 's' END], 'n': lists}},
      {{'signal': 'trust-markers', 'examples': {_terms(C.TRUST_TERMS)}, 'n': -1}},
      {{'signal': 'freshness', 'examples': {firsts(f"regexp_extract_all(body_text, '{_DAY}')")}, 'n': -1}},
      {{'signal': 'versions', 'examples': {firsts(f"regexp_extract_all(body_text, '{_VER}')")}, 'n': -1}},
      {{'signal': 'pricing-proof', 'examples': {_terms(C.PRICING_TERMS)}, 'n': -1}},
      {{'signal': 'comparison-criteria', 'examples': {_terms(C.COMPARISON_TERMS)}, 'n': -1}},
      {{'signal': 'workflow-proof', 'examples': {_terms(C.WORKFLOW_TERMS)}, 'n': -1}},
      {{'signal': 'outcome-proof', 'examples': {_terms(C.OUTCOME_TERMS)}, 'n': -1}},
      {{'signal': 'docs-proof', 'examples': {_terms(C.DOCS_TERMS)}, 'n': -1}},
      {{'signal': 'body-depth', 'examples': [word_count || ' words'], 'n': CASE WHEN page_type IN ('pricing', 'security', 'docs', 'compare', 'use-case') THEN word_count // 80 ELSE 0 END}}
    ]) AS u FROM f0) AS x
  WHERE CASE WHEN u.n = -1 THEN len(u.examples) ELSE u.n END > 0),
evidence AS (SELECT page_id, signal, CASE WHEN n = -1 THEN len(examples) ELSE n END AS n, examples[1:3] AS examples FROM ev),
has AS (SELECT page_id, list(signal) AS signals FROM evidence GROUP BY page_id),
f AS (SELECT f0.*, coalesce(has.signals, []) AS signals FROM f0 LEFT JOIN has USING (page_id))"""

# JSON-LD: blocks, nodes (array items and one @graph level), types, records, questions
_JSONLD = f"""
blocks AS (SELECT page_id, site_id, url, body_text, ld::JSON AS doc FROM parts WHERE ld <> '' AND json_valid(ld)),
top AS (
  SELECT page_id, site_id, url, body_text, unnest(CASE WHEN json_type(doc) = 'ARRAY' THEN json_extract(doc, '$[*]') ELSE [doc] END) AS node FROM blocks),
nodes AS (
  SELECT page_id, site_id, url, body_text, 0 AS depth, node FROM top
  UNION ALL
  SELECT page_id, site_id, url, body_text, 1, unnest(json_extract(node, '$."@graph"[*]')) FROM top),
kinds AS (
  SELECT *, unnest(CASE json_type(node, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(node, '$."@type"[*]')
    WHEN 'VARCHAR' THEN [json_extract_string(node, '$."@type"')] ELSE [] END) AS kind FROM nodes),
records AS (
  SELECT *, {clean("json_extract_string(node, '$.name')", 180)} AS name,
    {clean("json_extract_string(node, '$.description')", 180)} AS description,
    {clean("json_extract_string(node, '$.url')", 180)} AS ld_url,
    {clean("coalesce(json_extract_string(node, '$.applicationCategory'), json_extract_string(node, '$.category'))", 180)} AS category
  FROM kinds WHERE lower(kind) IN ('faqpage', 'organization', 'softwareapplication', 'product')),
questions AS (
  SELECT page_id, site_id, url, body_text, kind,
    {clean("coalesce(json_extract_string(q, '$.name'), json_extract_string(q, '$.text'))", 140)} AS question,
    {clean("coalesce(json_extract_string(q, '$.acceptedAnswer.text'), json_extract_string(q, '$.acceptedAnswer.name'))", 180)} AS answer
  FROM (SELECT *, unnest(json_extract(node, '$.mainEntity[*]')) AS q FROM records WHERE lower(kind) = 'faqpage') AS x),
shown AS (
  SELECT page_id, site_id, url, kind AS record_type, 'name' AS field, name AS value, body_text FROM records
  UNION ALL SELECT page_id, site_id, url, kind, 'description', description, body_text FROM records
  UNION ALL SELECT page_id, site_id, url, kind, 'category', category, body_text FROM records
  UNION ALL SELECT page_id, site_id, url, kind, 'faq.question', question, body_text FROM questions
  UNION ALL SELECT page_id, site_id, url, kind, 'faq.answer', answer, body_text FROM questions),
signals AS (
  SELECT page_id, site_id, url, record_type, field, value,
    contains(lower(body_text), {squash('lower(value)')}) OR {coverage('body_text', 'value')} >= 0.55 AS visible
  FROM shown WHERE length(value) > 0),
types AS (SELECT page_id, list(DISTINCT lower(kind)) AS kinds FROM kinds GROUP BY page_id),
hidden AS (SELECT page_id, list(DISTINCT field) AS fields FROM signals WHERE NOT visible GROUP BY page_id)"""

# Links of the derived sites: the added ones as they were built, then those of the given html
_HEAD = cut("first_heading", 120)
_CTX = clean(f"heading || ' ' || CASE WHEN contains(lower(block), lower(heading)) THEN block ELSE {cut('(heading || chr(32) || block)', 180)} END", 200)
_ANCHORS = "regexp_extract_all(given, '<a href=\"([^\"]*)\">([^<]*)</a>', {n})"
_SHOWN = squash(unescape("shown"))
_LINKS = f"""
raw_links AS (
  SELECT page_id, site_id, url, base_url, first_heading, u.ord AS ord, u.dst AS dst, u.anchor AS anchor, u.block AS block, u.heading AS own FROM (
    SELECT *, unnest(CASE (j + k) % 3
      WHEN 0 THEN [
        {{'ord': 0, 'dst': '/', 'anchor': 'Home', 'block': 'Home', 'heading': ''}},
        {{'ord': 1, 'dst': '/pricing', 'anchor': 'Pricing plans', 'block': 'Pricing plans', 'heading': ''}},
        {{'ord': 2, 'dst': '/docs/start', 'anchor': 'Documentation guide', 'block': 'Documentation guide', 'heading': ''}}]
      WHEN 1 THEN [
        {{'ord': 0, 'dst': '/security', 'anchor': 'here', 'block': 'See here and more, mail us', 'heading': ''}},
        {{'ord': 1, 'dst': '/faq', 'anchor': 'more', 'block': 'See here and more, mail us', 'heading': ''}}]
      ELSE [
        {{'ord': 0, 'dst': '/compare/alpha', 'anchor': 'alternatives', 'block': 'Read how teams evaluate alternatives.', 'heading': 'Compare options'}},
        {{'ord': 1, 'dst': '/integrations', 'anchor': 'Integrations list', 'block': NULL, 'heading': 'Compare options'}},
        {{'ord': 2, 'dst': '/use-case/sales', 'anchor': 'sales', 'block': NULL, 'heading': 'Compare options'}}] END) AS u
    FROM parts WHERE page_id >= 0) AS x
  UNION ALL
  SELECT page_id, site_id, url, base_url, first_heading, 3 + ord,
    CASE WHEN regexp_matches(href, '^/+$') THEN '/' ELSE regexp_replace({encoded(unescape('href'))}, '/+$', '') END, {cut(_SHOWN, 120)}, {cut(_SHOWN, 180)}, '' FROM (
    SELECT *, unnest({_ANCHORS.format(n=1)}) AS href, unnest({_ANCHORS.format(n=2)}) AS shown,
      generate_subscripts({_ANCHORS.format(n=1)}, 1) AS ord FROM parts) AS y),
headed AS (SELECT *, CASE WHEN own <> '' THEN own ELSE {_HEAD} END AS heading FROM raw_links),
ctx AS (SELECT *, CASE WHEN block IS NULL THEN heading ELSE {_CTX} END AS whole FROM headed),
every_link AS (
  SELECT page_id, site_id, url AS src_url, ord AS link_ord, base_url || dst AS dst_url, anchor AS anchor_text,
    CASE WHEN length(whole) >= 32 THEN whole WHEN heading <> '' THEN {clean("heading || ' ' || anchor", 160)} ELSE anchor END AS source_context
  FROM ctx),
links AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, dst_url, lower(anchor_text), lower(source_context) ORDER BY link_ord) AS n FROM every_link) AS x WHERE n = 1)"""


def with_sites(*extra: str) -> str:
    """WITH clause holding the derived pages and the named parts."""
    chosen = {"features": _FEATURES, "jsonld": _JSONLD, "links": _LINKS}
    ctes = [f"pages_d AS ({D.SITE_PAGES})", _PARTS] + [chosen[e] if e in chosen else e for e in extra]
    return "WITH " + ",\n".join(ctes)


SITES = f"sites AS ({D.SITES})"
BRANDS = f"brands AS ({D.BRANDS})"
COMPETITORS = f"competitors AS ({D.COMPETITORS})"
FACTS = f"facts AS ({D.FACTS})"
RIVALS = "rivals AS (SELECT site_id, list(name ORDER BY comp_ord) AS names FROM competitors GROUP BY site_id)"

# ---- issues ------------------------------------------------------------------------------

_ROBOTS = f"""
robots AS (
  SELECT site_id, text,
    length(trim(coalesce(text, ''))) > 0 AS has_file,
    contains(coalesce(text, ''), '# closed') AS blocked_all,
    CASE WHEN contains(coalesce(text, ''), 'PerplexityBot') THEN ['PerplexityBot'] ELSE [] END AS bots
  FROM ({D.ROBOTS}) AS r)"""

_PAGE_RULES = {
    6: "is_key AND noindex",
    7: "is_key AND title = ''",
    8: "is_key AND title <> '' AND length(title) < 20",
    9: "is_key AND meta_description = ''",
    10: "is_key AND h1 = ''",
    11: "is_key AND h1_count > 1",
    12: "(page_type IN ('home', 'product', 'pricing', 'security', 'docs') AND word_count < 150) OR "
        "(page_type IN ('faq', 'compare', 'integrations', 'use-case') AND word_count < 80 AND lists = 0 AND n_tables = 0)",
    13: "is_key AND len(headings) < 2",
    14: "is_key AND word_count < 120 AND scripts >= 5",
    15: "is_key AND controls > 0 AND aria_controls / controls < 0.5",
    16: "list_contains(hidden_fields, 'name')",
    17: "list_contains(hidden_fields, 'description')",
    18: "list_contains(hidden_fields, 'faq.question')",
    19: "list_contains(hidden_fields, 'faq.answer')",
    20: "page_type = 'home' AND len(kinds) = 0",
    21: "page_type = 'faq' AND NOT list_contains(kinds, 'faqpage')",
    22: "list_contains(kinds, 'faqpage') AND lists = 0 AND len(list_filter(headings, lambda x: contains(x, '?'))) = 0",
    23: "page_type IN ('home', 'product') AND list_has_any(kinds, ['product', 'softwareapplication', 'service']) "
        f"AND {coverage('page_text', 'brand_category')} < 0.4",
    29: "page_type = 'faq' AND lists = 0 AND len(list_filter(headings, lambda x: contains(x, '?'))) < 2",
    30: "page_type = 'compare' AND len(list_filter(names, lambda x: contains(lower(page_text), lower(x)))) = 0",
    31: "page_type = 'compare' AND len(headings) < 2",
    32: "page_type = 'use-case' AND len(headings) < 2",
}


def _groups(page_type_name: str) -> str:
    groups = C.EVIDENCE_GROUPS[page_type_name][4]
    return " + ".join(f"list_has_any(signals, {text_list(kinds)})::INT" for _, kinds in groups)


for _type, (_no, _, _, _needed, _) in C.EVIDENCE_GROUPS.items():
    _PAGE_RULES[_no] = f"page_type = '{_type}' AND {_groups(_type)} < {_needed}"


def _severity(no: int) -> str:
    from citeframe.operators.rule_catalog import RULES

    if no == 12:
        return "CASE WHEN page_type IN ('faq', 'compare', 'integrations', 'use-case') THEN 'info' ELSE 'warn' END"
    for name, (rule_no, _, severity, _, _) in C.EVIDENCE_GROUPS.items():
        if no == rule_no:
            return f"CASE WHEN {_groups(name)} = 0 THEN 'warn' ELSE '{severity}' END"
    return f"'{RULES[no].severity}'"


_SITE_RULES = {
    1: ("1", "NOT has_file", "NULL"),
    2: ("1", "coalesce(n_pages, 0) = 0", "NULL"),
    3: ("1", "blocked_all", "NULL"),
    33: ("3", "home_url IS NULL", "NULL"),
    34: ("3", f"home_url IS NOT NULL AND {coverage('home_text', 'brand_category')} < 0.5", "home_url"),
    35: ("3", "home_url IS NOT NULL AND personas_s <> '' AND len(list_filter(string_split(personas_s, '|'), lambda x: "
         f"{coverage('home_text', 'x')} >= 0.5)) = 0", "home_url"),
    36: ("3", "home_url IS NOT NULL AND use_cases_s <> '' AND len(list_filter(string_split(use_cases_s, '|'), lambda x: "
         f"{coverage('home_text', 'x')} >= 0.5)) = 0", "home_url"),
    37: ("3", "home_url IS NOT NULL AND linked_types < 3", "home_url"),
    38: ("3", "coalesce(n_pricing, 0) = 0", "NULL"),
    39: ("3", "coalesce(n_security, 0) = 0", "NULL"),
    40: ("3", "coalesce(n_docs, 0) = 0", "NULL"),
    41: ("3", "coalesce(n_faq, 0) = 0", "NULL"),
    42: ("3", "coalesce(n_compare, 0) = 0", "NULL"),
    43: ("3", "coalesce(n_integrations, 0) = 0", "NULL"),
    44: ("3", "coalesce(n_use_case, 0) < 3", "NULL"),
    45: ("3", "coalesce(n_compare, 0) > 0 AND len(names) > 0 AND NOT compare_named", "NULL"),
}

_LINK_WARN = "CASE WHEN page_type IN ('pricing', 'security', 'docs', 'faq', 'compare') THEN 'warn' ELSE 'info' END"
_LINK_RULES = {
    46: "n_sources < CASE WHEN page_type IN ('faq', 'compare', 'integrations', 'use-case') THEN 2 ELSE 1 END OR n_explained = 0",
    47: "n_links > 0 AND n_informative = 0",
    48: "n_links > 0 AND n_supportive = 0",
}

_KEYWORDS = "CASE page_type " + " ".join(
    f"WHEN '{t}' THEN {text_list(v)}" + (f" || {tokens(chr(40) + 'title || chr(32) || h1)')}" if t == "use-case" else "")
    for t, v in C.PROOF_KEYWORDS.items()
) + " END"

_RULE_INPUTS = f"""
pf AS (
  SELECT f.*, coalesce(t.kinds, []) AS kinds, coalesce(h.fields, []) AS hidden_fields,
    coalesce(r.names, []) AS names, coalesce(b.category, '') AS brand_category
  FROM f LEFT JOIN types AS t USING (page_id) LEFT JOIN hidden AS h USING (page_id)
    LEFT JOIN rivals AS r ON r.site_id = f.site_id LEFT JOIN brands AS b ON b.site_id = f.site_id),
homes AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY page_rank, url) AS rn FROM pf WHERE page_type = 'home') AS x WHERE rn = 1),
linked AS (
  SELECT h.site_id, count(DISTINCT t.page_type) AS n FROM homes AS h JOIN links AS l ON l.page_id = h.page_id
    JOIN f AS t ON t.site_id = h.site_id AND t.url = l.dst_url AND t.page_type <> 'home' GROUP BY h.site_id),
counts AS (
  SELECT site_id, count(*) AS n_pages, {", ".join(f"count(*) FILTER (page_type = '{t}') AS n_{t.replace('-', '_')}" for t in C.KEY_PAGE_TYPES)},
    coalesce(bool_or(page_type = 'compare' AND len(list_filter(names, lambda x: contains(lower(page_text), lower(x)))) > 0), FALSE) AS compare_named
  FROM pf GROUP BY site_id),
sf AS (
  SELECT s.site_id, coalesce(r.has_file, FALSE) AS has_file, coalesce(r.blocked_all, FALSE) AS blocked_all, coalesce(r.bots, []) AS bots,
    c.* EXCLUDE (site_id), h.url AS home_url, h.page_text AS home_text, coalesce(l.n, 0) AS linked_types,
    b.category AS brand_category, b.personas_s, b.use_cases_s, coalesce(v.names, []) AS names
  FROM sites AS s LEFT JOIN robots AS r USING (site_id) LEFT JOIN counts AS c USING (site_id) LEFT JOIN homes AS h USING (site_id)
    LEFT JOIN linked AS l USING (site_id) LEFT JOIN brands AS b USING (site_id) LEFT JOIN rivals AS v USING (site_id)),
proof AS (SELECT *, {_KEYWORDS} AS kw FROM f WHERE page_type IN {tuple(C.KEY_PROOF_PAGE_TYPES)}),
judged AS (
  SELECT p.page_id AS dst_id, l.src_url, l.link_ord, l.anchor_text, l.source_context, s.page_rank AS src_rank,
    len(list_filter(p.kw, lambda w: contains(lower(l.source_context), w))) > 0 AS supportive,
    len(list_filter(p.kw, lambda w: contains(lower(l.anchor_text), w))) > 0
      OR (lower(l.anchor_text) NOT IN {tuple(C.GENERIC_ANCHORS)} AND (contains(l.anchor_text, ' ') OR length(l.anchor_text) >= 8)) AS informative
  FROM links AS l JOIN proof AS p ON p.site_id = l.site_id AND p.url = l.dst_url AND l.src_url <> l.dst_url JOIN f AS s ON s.page_id = l.page_id),
lf AS (
  SELECT p.*, coalesce(j.n_sources, 0) AS n_sources, coalesce(j.n_links, 0) AS n_links, coalesce(j.n_informative, 0) AS n_informative,
    coalesce(j.n_supportive, 0) AS n_supportive, coalesce(j.n_explained, 0) AS n_explained
  FROM proof AS p LEFT JOIN (
    SELECT dst_id AS page_id, count(DISTINCT src_url) AS n_sources, count(*) AS n_links, count(*) FILTER (informative) AS n_informative,
      count(*) FILTER (supportive) AS n_supportive, count(*) FILTER (informative OR supportive) AS n_explained
    FROM judged GROUP BY dst_id) AS j USING (page_id))"""


def rule_select(no: int) -> str:
    """SELECT of one rule: site_id, rule_id, severity, title, category, bucket, page_url and the sort key."""
    from citeframe.operators.rule_catalog import RULES

    rule = RULES[no]
    fixed = f"'{rule.rule_id}' AS rule_id, {{sev}} AS severity, {{title}} AS title, '{rule.category}' AS category, '{rule.bucket}' AS bucket"
    title = "'" + rule.title.replace("'", "''") + "'"
    plain = fixed.format(sev=_severity(no), title=title)
    if no == 4:
        named = fixed.format(sev="'warn'", title="bot || ' is blocked'")
        return f"SELECT site_id, {named}, NULL AS page_url, 1 AS s1, 0 AS s2, '' AS s3, 4 AS s4, CASE bot WHEN 'OAI-SearchBot' THEN 0 ELSE 1 END AS s5 FROM (SELECT site_id, unnest(bots) AS bot FROM sf) AS x"
    if no == 5:
        return f"SELECT site_id, {plain}, url AS page_url, 2 AS s1, page_rank AS s2, url AS s3, 5 AS s4, 0 AS s5 FROM pf WHERE NOT is_ok"
    if no in _PAGE_RULES:
        return f"SELECT site_id, {plain}, url AS page_url, 2 AS s1, page_rank AS s2, url AS s3, {no} AS s4, 0 AS s5 FROM pf WHERE is_ok AND ({_PAGE_RULES[no]})"
    if no in _SITE_RULES:
        phase, condition, url = _SITE_RULES[no]
        return f"SELECT site_id, {plain}, {url} AS page_url, {phase} AS s1, 0 AS s2, '' AS s3, {no} AS s4, 0 AS s5 FROM sf WHERE {condition}"
    link = fixed.format(sev=_LINK_WARN, title=title)
    return f"SELECT site_id, {link}, url AS page_url, 4 AS s1, page_rank AS s2, url AS s3, {no} AS s4, 0 AS s5 FROM lf WHERE {_LINK_RULES[no]}"


def with_rules(*extra: str) -> str:
    return with_sites("features", "jsonld", "links", SITES, BRANDS, COMPETITORS, RIVALS, _ROBOTS, _RULE_INPUTS, *extra)


def _issue_id() -> str:
    return f"{slug('title')} || CASE WHEN page_url IS NULL THEN '' ELSE '-' || {slug('page_url')} END"


ISSUES = "issues AS (SELECT *, " + _issue_id() + " AS issue_id FROM (" + "\nUNION ALL ".join(rule_select(n) for n in range(1, 49)) + ") AS u)"


def with_issues(*extra: str) -> str:
    return with_rules(ISSUES, *extra)


SEQ = "s1, s2, s3, s4, s5"
