"""Input tables for the registered queries, derived from the given tables.

The given pages have no meta tags, sections, JSON-LD, tables or controls, so those parts are added to their whole
html by arithmetic on the row ids, and short pages stand beside them. The same SQL text builds the inputs on both engines; what is
compared is the work done on them. Every derived table has rows in proportion to its base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ---- sites of twelve pages each ---------------------------------------------------------

_PATH = """CASE {j}
    WHEN 0 THEN CASE WHEN {k} % 7 = 3 THEN '/welcome/' || CAST({k} AS STRING) ELSE '/' END
    WHEN 1 THEN CASE WHEN {k} % 4 = 1 THEN '/about' ELSE '/pricing' END
    WHEN 2 THEN CASE WHEN {k} % 5 = 2 THEN '/team' ELSE '/security' END
    WHEN 3 THEN CASE WHEN {k} % 6 = 4 THEN '/help' ELSE '/faq' END
    WHEN 4 THEN CASE WHEN {k} % 9 = 5 THEN '/stories' ELSE '/compare/alpha' END
    WHEN 5 THEN CASE WHEN {k} % 5 = 3 THEN '/handbook' ELSE '/docs/start' END
    WHEN 6 THEN CASE WHEN {k} % 8 = 6 THEN '/partners' ELSE '/integrations' END
    WHEN 7 THEN '/use-case/sales'
    WHEN 8 THEN '/use-case/support'
    WHEN 9 THEN CASE WHEN {k} % 3 = 0 THEN '/blog/ops' ELSE '/use-case/ops' END
    WHEN 10 THEN '/product'
    ELSE '/page/' || CAST({k} AS STRING) END"""


def path_sql(j: str, k: str) -> str:
    return _PATH.replace("{j}", j).replace("{k}", k)


# Every given page keeps its whole html; head elements, links and sections are added around its body.
_GIVEN_SITE_PAGES = f"""
SELECT page_id, k, j, 'site-' || CAST(k AS STRING) AS site_id, 'https://s' || CAST(k AS STRING) || '.example.com' AS base_url,
  'https://s' || CAST(k AS STRING) || '.example.com' || path AS url,
  CAST(CASE WHEN page_id % 31 = 30 THEN 404 WHEN page_id % 37 = 36 THEN 0 ELSE 200 END AS INT) AS status,
  'text/html' AS content_type,
  CASE WHEN page_id % 31 = 30 THEN 'HTTP 404' END AS fetch_error,
  split_part(html, '</head>', 1)
  || CASE WHEN page_id % 4 = 1 THEN '' ELSE '<meta name="description" content="Guide ' || CAST(page_id AS STRING)
       || ' for workflow automation teams">' END
  || CASE WHEN page_id % 10 = 7 THEN '<meta name="robots" content="NOINDEX, follow">' ELSE '' END
  || CASE WHEN page_id % 41 = 40 THEN '<meta http-equiv="refresh" content="0; url=/pricing">' ELSE '' END
  || CASE WHEN page_id % 13 = 6 THEN '<script>a(1)</script><script>a(2)</script><script>a(3)</script><script>a(4)</script><script>a(5)</script>'
       ELSE '<script>var t="</p>";</script>' END
  || CASE
       WHEN page_id % 17 = 5 THEN '<script type="application/ld+json">not json</script>'
       WHEN j = 0 AND k % 3 <> 1 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"SoftwareApplication","name":"Brand '
         || CAST(k AS STRING) || '","description":"Workflow automation for teams","applicationCategory":"Business"}}</script>'
       WHEN j = 3 AND k % 4 <> 1 THEN '<script type="application/ld+json">{{"@graph":[{{"@type":["FAQPage"],"mainEntity":[{{"name":"What does it cost?","acceptedAnswer":{{"text":"Plans start at $19 per seat"}}}},{{"name":"Where is the <b>warehouse</b> located?","acceptedAnswer":{{"name":"Somewhere entirely different"}}}}]}}]}}</script>'
       WHEN j = 10 THEN '<script type="application/ld+json">[{{"@type":"Product","name":"Gadget number '
         || CAST(page_id AS STRING) || '","category":"Hardware","url":"https://example.com/p"}},{{"@type":"Organization","name":"Home","description":"Entirely unrelated corporate boilerplate"}}]</script>'
       ELSE '' END
  || '</head><body>'
  || CASE (j + k) % 3
       WHEN 0 THEN '<nav><ul><li><a href="/">Home</a></li><li><a href="/pricing">Pricing plans</a></li><li><a href="/docs/start">Documentation guide</a></li><li><a href="https://other.example.org/x">partner</a></li></ul></nav>'
       WHEN 1 THEN '<p>See <a href="/security/">here</a> and <a href="../faq#top">more</a>, mail <a href="mailto:a@b.c">us</a></p>'
       ELSE '<div><h2>Compare options</h2><p>Read how teams evaluate <a href="/compare/alpha">alternatives</a>.</p><a href="/integrations" aria-label="Integrations list"></a><a href="/use-case/sales"></a></div>' END
  || given || '<main>'
  || CASE WHEN (j + 2 * k) % 4 <> 0 THEN '<section><h2>What does it cost?</h2><p>Plans start at $19 per seat, 99.5% uptime, 30 days trial. Updated Jan 2024 v2.1 with SOC 2, SSO and encryption. We reduce setup time.</p></section><section><h3>How to deploy the workflow</h3><ol><li>setup quickstart api guide</li></ol></section>' ELSE '' END
  || CASE WHEN page_id % 8 = 3 THEN '<h1>Second heading</h1>' ELSE '' END
  || CASE WHEN page_id % 4 = 2 THEN '<table><tr><td>Us vs Rival criteria</td></tr></table>' ELSE '' END
  || CASE WHEN page_id % 5 = 1 THEN '<button>Go</button><input type="text"><button aria-label="Menu"></button>' ELSE '' END
  || '</main></body></html>' AS html, given
FROM (
  SELECT page_id, k, j, {path_sql('j', 'k')} AS path, html, split_part(split_part(html, '<body>', 2), '</body>', 1) AS given
  FROM (SELECT page_id, CAST(floor(page_id / 12) AS BIGINT) AS k, page_id % 12 AS j, html FROM pages) AS x) AS y
"""

# Short pages beside the given ones: no or short titles, no heading, scripts only, data without what it names.
_NOTE_PAGES = """
SELECT page_id, k, j, site_id, base_url, base_url || path || 'note-' || CAST(-page_id AS STRING) AS url, CAST(200 AS INT) AS status,
  'text/html' AS content_type, CAST(NULL AS STRING) AS fetch_error,
  '<!DOCTYPE html><html><head>'
  || CASE page_id % 4 WHEN 0 THEN '' WHEN -1 THEN '<title>Short</title>' ELSE '<title>One of several short notes</title>' END
  || CASE WHEN page_id % 6 = -2 THEN '<script>a(1)</script><script>a(2)</script><script>a(3)</script><script>a(4)</script><script>a(5)</script>' ELSE '' END
  || CASE WHEN path = '/faq/' AND page_id % 5 <> -3 THEN '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"name":"Is it short?","acceptedAnswer":{"text":"It is a short text"}}]}</script>' ELSE '' END
  || '</head><body>' || CASE WHEN page_id % 5 = 0 THEN '' ELSE '<h1>Note</h1>' END || '<p>short text</p></body></html>' AS html, '' AS given
FROM (
  SELECT -1 - page_id AS page_id, CAST(floor(page_id / 12) AS BIGINT) AS k, CAST(12 AS BIGINT) AS j,
    'site-' || CAST(CAST(floor(page_id / 12) AS BIGINT) AS STRING) AS site_id,
    'https://s' || CAST(CAST(floor(page_id / 12) AS BIGINT) AS STRING) || '.example.com' AS base_url,
    CASE CAST(floor(page_id / 3) AS BIGINT) % 7 WHEN 0 THEN '/pricing/' WHEN 1 THEN '/security/' WHEN 2 THEN '/docs/' WHEN 3 THEN '/faq/'
      WHEN 4 THEN '/compare/' WHEN 5 THEN '/integrations/' ELSE '/use-case/' END AS path
  FROM pages WHERE page_id % 3 = 1) AS x
"""

SITE_PAGES = f"{_GIVEN_SITE_PAGES} UNION ALL {_NOTE_PAGES}"

# the given pages, each with a link to the first page of its host
HOST_LINKED = """
SELECT p.url, f.first_url, p.html || '<p>Start at <a href="' || f.first_url || '">the first page</a></p>' AS html
FROM (SELECT url, html, split_part(url, '/', 3) AS host FROM pages) AS p
JOIN (SELECT split_part(url, '/', 3) AS host, min(url) AS first_url FROM pages GROUP BY split_part(url, '/', 3)) AS f ON f.host = p.host
"""

_SITE_BASE = """SELECT page_id, CAST(floor(page_id / 12) AS BIGINT) AS k FROM pages WHERE page_id % 12 = 0"""

SITES = f"""
SELECT 'site-' || CAST(k AS STRING) AS site_id, 'https://s' || CAST(k AS STRING) || '.example.com' AS base_url
FROM ({_SITE_BASE}) AS b
UNION ALL
SELECT 'void-' || CAST(k AS STRING) AS site_id, 'https://v' || CAST(k AS STRING) || '.example.com' AS base_url
FROM ({_SITE_BASE}) AS b WHERE k % 10 = 9"""

ROBOTS = f"""
SELECT 'site-' || CAST(k AS STRING) AS site_id,
  CASE k % 5
    WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) || 'Sitemap: https://s' || CAST(k AS STRING) || '.example.com/sitemap-extra.xml'
    WHEN 2 THEN '# closed' || chr(13) || chr(10) || 'Disallow: /' || chr(10) || 'bad line'
    WHEN 3 THEN 'User-agent: OAI-SearchBot' || chr(10) || 'User-agent: PerplexityBot' || chr(10) || ' disallow : / '
    WHEN 4 THEN 'User-agent: PerplexityBot' || chr(10) || 'Disallow: /' || chr(10) || 'User-Agent: *' || chr(10) || 'Disallow: /private'
  END AS text
FROM ({_SITE_BASE}) AS b WHERE k % 10 <> 0"""

# plain entries, CDATA, prefixes, entities, comments and files that break off
SITEMAPS = f"""
SELECT site_id, base_url || '/sitemap-' || CAST(page_id AS STRING) || '.xml' AS sitemap_url,
  '<?xml version="1.0"?><!-- <url><loc>https://commented.example.org/</loc></url> -->'
  || CASE page_id % 4
    WHEN 1 THEN '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc><![CDATA[' || url || ']]></loc></url>'
    WHEN 2 THEN '<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc>' || url || '</sm:loc></sm:url>'
    ELSE '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>' || url || '</loc></url>' END
  || '<url a=">"><loc> ' || base_url || '/shared?a=1' || CASE WHEN page_id % 3 = 0 THEN '&#38;' ELSE '&amp;' END || 'b=2 </loc><lastmod>2024-01-01</lastmod></url>'
  || CASE page_id % 4 WHEN 3 THEN '<url><loc>https://broken.example.org/' WHEN 2 THEN '</sm:urlset>' ELSE '</urlset>' END AS xml
FROM ({SITE_PAGES}) AS p WHERE j <> 11
UNION ALL
SELECT site_id, base_url || '/sitemap_index.xml' AS sitemap_url,
  '<sitemapindex><sitemap><loc>' || base_url || '/sitemap-' || CAST(page_id - 11 AS STRING) || '.xml</loc></sitemap><sitemap><loc>'
  || base_url || '/sitemap-' || CAST(page_id - 7 AS STRING) || '.xml</loc></sitemap></sitemapindex>' AS xml
FROM ({SITE_PAGES}) AS p WHERE j = 11 AND k % 6 <> 5"""


def _brands(base: str) -> str:
    return f"""
SELECT 'site-' || CAST(k AS STRING) AS site_id, 'Brand ' || CAST(k AS STRING) AS name,
  's' || CAST(k AS STRING) || '.example.com' AS domain,
  CASE k % 3 WHEN 0 THEN 'workflow automation' WHEN 1 THEN 'analytics platform software' ELSE 'the that with' END AS category,
  'Brand ' || CAST(k AS STRING) || ' keeps teams aligned with simple plans' AS one_liner,
  CASE WHEN k % 4 = 0 THEN '' ELSE CASE k % 4 WHEN 2 THEN 'workflow teams|nobody' ELSE 'marketing leaders|platform engineers' END END AS personas_s,
  CASE WHEN k % 4 = 1 THEN '' ELSE 'support rollout|deploy workflow setup' END AS use_cases_s,
  'docs.example.net|wiki.example.org' AS trusted_s
FROM ({base}) AS b"""


def _facts(base: str) -> str:
    return f"""
SELECT 'site-' || CAST(k AS STRING) AS site_id, CAST(1 AS INT) AS fact_ord, 'f1' AS fact_id, 'pricing' AS fact_type,
  'Plans start at nineteen dollars' AS text FROM ({base}) AS b
UNION ALL
SELECT 'site-' || CAST(k AS STRING) AS site_id, CAST(2 AS INT) AS fact_ord, 'f2' AS fact_id, 'security' AS fact_type,
  'Encryption protects every account' AS text FROM ({base}) AS b WHERE k % 2 = 0"""


def _competitors(base: str) -> str:
    one = "SELECT 'site-' || CAST(k AS STRING) AS site_id, CAST({n} AS INT) AS comp_ord, '{name}' AS name, CAST(NULL AS STRING) AS domain, CAST(NULL AS STRING) AS category FROM ({base}) AS b WHERE {where}"
    rows = [(1, "Rival", "k % 5 <> 4"), (2, "Otherco", "k % 2 = 0"), (3, "Options", "k % 3 = 1")]
    return " UNION ALL ".join(one.format(n=n, name=name, base=base, where=w) for n, name, w in rows)


BRANDS, FACTS, COMPETITORS = _brands(_SITE_BASE), _facts(_SITE_BASE), _competitors(_SITE_BASE)

# ---- language pairs for the metadata checks ---------------------------------------------

# Every given page keeps its whole html; tags, data and links are added before its title and behind its body.
META_PAGES = """
SELECT page_id, g, site_id, base_url, url,
  CASE WHEN page_id % 19 = 7 THEN replace(split_part(html, '<title>', 1), '<head>', '<head><title> </title>') ELSE split_part(html, '<title>', 1) END
  || CASE WHEN page_id % 7 = 2 THEN '' ELSE '<meta name="description" content="About page ' || CAST(page_id AS STRING) || '">' END
  || CASE WHEN canonical = '' THEN '' ELSE '<link rel="canonical" href="' || canonical || '">' END
  || '<meta property="og:title" content="t"><meta property="og:description" content="d">'
  || '<meta property="og:url" content="' || CASE WHEN page_id % 8 = 3 THEN '/relative' ELSE canonical END || '">'
  || CASE WHEN page_id % 5 = 2 THEN '' ELSE '<meta property="og:image" content="https://img.example.com/a.png">' END
  || '<meta property="og:image:alt" content="' || CASE WHEN page_id % 6 = 5 THEN '  ' ELSE 'alt' END || '">'
  || '<meta name="twitter:card" content="c"><meta name="twitter:title" content="t"><meta name="twitter:description" content="d">'
  || CASE WHEN page_id % 9 = 1 THEN '' ELSE '<meta name="twitter:image" content="' || CASE WHEN page_id % 6 = 1 THEN 'a.png' ELSE 'https://img.example.com/b.png' END || '">' END
  || '<meta name="twitter:image:alt" content="alt">'
  || CASE WHEN page_id % 10 = 4 THEN '' ELSE '<link rel="alternate" hreflang="en" href="' || base_url || '/en/' || tail || '">' END
  || '<link rel="alternate" hreflang="zh-CN" href="' || CASE WHEN page_id % 12 = 5 THEN '/zh/' ELSE base_url || '/zh/' END || tail || '">'
  || CASE WHEN page_id % 11 = 6 THEN '' ELSE '<link rel="alternate" hreflang="x-default" href="' || base_url || '/' || CASE WHEN page_id % 13 = 2 THEN 'en/' ELSE '' END || tail || '">' END
  || CASE
       WHEN page_id % 14 = 9 THEN ''
       WHEN page_id % 15 = 8 THEN '<script type="application/ld+json">{broken</script>'
       ELSE '<script type="application/ld+json">[{"@type":"WebPage","url":"' || CASE WHEN page_id % 16 = 3 THEN 'https://elsewhere.example.com/' ELSE canonical END
         || '"' || CASE WHEN page_id % 17 = 4 THEN ',"aggregateRating":5' ELSE '' END || '}'
         || CASE WHEN page_id % 18 = 10 THEN '' ELSE ',{"@type":"BreadcrumbList","itemListElement":[{"item":"' || base_url || '/'
              || CASE WHEN page_id % 20 = 11 THEN 'fr/' ELSE lang || '/' END || '"},{"item":{"@id":"' || canonical || CASE WHEN page_id % 21 = 12 THEN 'x' ELSE '' END || '"}}]}' END
         || CASE WHEN tail = '' THEN ',{"@type":"SoftwareApplication","softwareVersion":"' || CASE WHEN g % 3 = 1 THEN '0.9' ELSE '1.0' END || '","url":"' || canonical || '"}' ELSE '' END
         || CASE WHEN n = 3 OR page_id % 22 = 13 THEN ',{"@type":"FAQPage","url":"' || canonical || '","mainEntity":[{"name":"Is it shown?"},{"name":"Hidden question ' || CAST(page_id AS STRING) || '?"}]}' ELSE '' END
         || ']</script>' END
  || '<title>' || split_part(html, '<title>', 2)
  || CASE page_id % 23 WHEN 15 THEN '<h1>b</h1>' ELSE '' END
  || '<p>Is it shown? 中文内容。' || CASE WHEN page_id % 3 = 1 THEN 'This is a long English sentence with many words. 后面。' ELSE '' END || '</p>'
  || CASE WHEN page_id % 4 = 3 THEN '<p>Use fast API tools here now.</p>' ELSE '' END
  || '<a href="' || base_url || '/' || lang || '/p1/">one</a><a href="/' || lang || '/gone' || CAST(page_id % 5 AS STRING) || '/">two</a><a href="/logo.svg">logo</a>' AS html
FROM (
  SELECT page_id, g, n, lang, tail, site_id, base_url, html, base_url || '/' || lang || '/' || tail AS url,
    CASE WHEN page_id % 24 = 16 THEN '' WHEN page_id % 25 = 17 THEN base_url || '/' || lang || '/'
      WHEN page_id % 26 = 18 THEN '/' || lang || '/' || tail ELSE base_url || '/' || lang || '/' || tail END AS canonical
  FROM (
    SELECT page_id, g, n, lang, html, 'lang-' || CAST(g AS STRING) AS site_id, 'https://l' || CAST(g AS STRING) || '.example.com' AS base_url,
      CASE WHEN n = 0 THEN '' WHEN n = 3 THEN 'faq/' ELSE 'p' || CAST(n AS STRING) || '/' END AS tail
    FROM (
      SELECT page_id, html, CAST(floor(page_id / 10) AS BIGINT) AS g, CAST(floor((page_id % 10) / 2) AS BIGINT) AS n,
        CASE WHEN page_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang
      FROM pages) AS x) AS y) AS z
UNION ALL
SELECT -1 - page_id AS page_id, CAST(floor(page_id / 10) AS BIGINT) AS g, 'lang-' || CAST(CAST(floor(page_id / 10) AS BIGINT) AS STRING) AS site_id,
  'https://l' || CAST(CAST(floor(page_id / 10) AS BIGINT) AS STRING) || '.example.com' AS base_url,
  'https://l' || CAST(CAST(floor(page_id / 10) AS BIGINT) AS STRING) || '.example.com/en/note' || CAST(page_id AS STRING) || '/' AS url,
  '<html><head><title>Note</title><link rel="canonical" href="https://l' || CAST(CAST(floor(page_id / 10) AS BIGINT) AS STRING) || '.example.com/en/note'
  || CAST(page_id AS STRING) || '/"></head><body><p>no heading</p></body></html>' AS html
FROM pages WHERE page_id % 23 = 14"""

_META_CANONICAL = f"""SELECT page_id, g, site_id, base_url, url,
  split_part(split_part(html, '<link rel="canonical" href="', 2), '"', 1) AS canonical FROM ({META_PAGES}) AS m"""

META_SITES = """
SELECT DISTINCT 'lang-' || CAST(CAST(floor(page_id / 10) AS BIGINT) AS STRING) AS site_id,
  'https://l' || CAST(CAST(floor(page_id / 10) AS BIGINT) AS STRING) || '.example.com' AS base_url FROM pages"""

META_LOCS = f"""
SELECT site_id, canonical AS loc FROM ({_META_CANONICAL}) AS p WHERE canonical <> '' AND page_id % 27 <> 19
UNION ALL
SELECT site_id, base_url || '/' AS loc FROM ({_META_CANONICAL}) AS p WHERE page_id % 10 = 0 AND g % 4 <> 2
UNION ALL
SELECT site_id, 'https://stray.example.org/' || CAST(page_id AS STRING) AS loc FROM ({_META_CANONICAL}) AS p WHERE page_id % 28 = 20
UNION ALL
SELECT site_id, url AS loc FROM ({_META_CANONICAL}) AS p WHERE page_id % 29 = 21"""

# ---- answers ----------------------------------------------------------------------------

ANSWERS = """
SELECT 'site-' || CAST(k AS STRING) AS site_id, 'run-' || CAST(conv_id % 2 AS STRING) AS run_id,
  conv_id * 100 + turn AS answer_ord,
  CASE WHEN conv_id % 23 = 22 THEN 'zz' ELSE 'p' || CAST(CAST(floor(conv_id / 2) AS BIGINT) % 4 AS STRING) END AS prompt_id,
  CAST((conv_id % 20) * 50 + turn AS INT) AS sample_index,
  CASE WHEN conv_id % 3 = 0 THEN 'perplexity' ELSE 'openai' END AS provider,
  CASE WHEN conv_id % 3 = 0 THEN 'model-b' ELSE 'model-a' END AS model,
  text || CASE h WHEN 1 THEN ' Brand ' || CAST(k AS STRING) || ' is a workflow automation and a strong choice.'
    WHEN 2 THEN ' We recommend brand ' || CAST(k AS STRING) || ' for plans.'
    WHEN 3 THEN ' Rival is fine.'
    WHEN 4 THEN ' Brand ' || CAST(k AS STRING) || ' keeps teams aligned with simple plans, unlike Rival and otherco. Encryption protects every account.'
    WHEN 5 THEN ' BRAND ' || CAST(k AS STRING) ELSE '' END AS answer_text,
  CASE WHEN conv_id % 5 = 0 THEN 'de' WHEN conv_id % 5 = 1 THEN 'en' END AS locale,
  CAST(CASE WHEN conv_id % 19 = 18 THEN 2 WHEN h IN (1, 4) THEN 1 + conv_id % 5 WHEN conv_id % 29 = 28 THEN 0 END AS INT) AS rank_position,
  CASE WHEN conv_id % 19 = 18 THEN 'eval' ELSE 'manual-import' END AS mode,
  CASE WHEN h IN (1, 3) THEN 'https://www.S' || CAST(k AS STRING) || '.example.com/about' WHEN h = 2 THEN 'https://other.example.org/z' END AS cit1,
  CASE WHEN conv_id % 4 = 0 THEN 'https://api.docs.example.net/y' WHEN conv_id % 4 = 1 THEN 'wiki.example.org' END AS cit2,
  h, k, conv_id, turn
FROM (
  SELECT conv_id, turn, text, (conv_id * 7 + turn * 3) % 6 AS h, CAST(floor(conv_id / 20) AS BIGINT) AS k
  FROM conversations WHERE role = 'assistant') AS c"""

# the higher run id is the earlier run, so that order by id and order by time differ
RUNS = """
SELECT DISTINCT 'site-' || CAST(CAST(floor(conv_id / 20) AS BIGINT) AS STRING) AS site_id, 'run-' || CAST(conv_id % 2 AS STRING) AS run_id,
  '2024-01-0' || CAST(2 - conv_id % 2 AS STRING) || 'T00:00:00Z' AS generated_at
FROM conversations"""

_ANSWER_SITE = "SELECT DISTINCT CAST(floor(conv_id / 20) AS BIGINT) AS k FROM conversations"
ANSWER_BRANDS, ANSWER_FACTS, ANSWER_COMPETITORS = _brands(_ANSWER_SITE), _facts(_ANSWER_SITE), _competitors(_ANSWER_SITE)

_PROMPT = "SELECT 'site-' || CAST(k AS STRING) AS site_id, '{id}' AS prompt_id, CAST({ord} AS INT) AS prompt_ord, '{cat}' AS category, '{id} template' AS template, '{sig}' AS expected_signal, {pri} AS priority, {intent} AS intent, {hold} AS holdout, {loc} AS locale FROM ({base}) AS b{where}"
_PROMPT_ROWS = [
    ("p0", 1, "discovery", "mention_or_recommend", "'high'", "'buy'", "FALSE", "'fr'", ""),
    ("p1", 2, "old", "brand_accuracy", "'low'", "CAST(NULL AS STRING)", "FALSE", "CAST(NULL AS STRING)", ""),
    ("p1", 3, "accuracy", "brand_accuracy_balance", "'low'", "CAST(NULL AS STRING)", "FALSE", "CAST(NULL AS STRING)", ""),
    ("p2", 4, "citation", "citation_and_presence", "CAST(NULL AS STRING)", "'learn'", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS STRING)", ""),
    ("p3", 5, "rank", "mention_position_accuracy", "'medium'", "'rank'", "TRUE", "'en'", " WHERE k % 2 = 0"),
    ("p3", 6, "rank", "other", "'high'", "'rank'", "FALSE", "'en'", " WHERE k % 2 = 1"),
]
PROMPTS = " UNION ALL ".join(
    _PROMPT.format(id=i, ord=o, cat=c, sig=s, pri=p, intent=n, hold=h, loc=lo, base=_ANSWER_SITE, where=w)
    for i, o, c, s, p, n, h, lo, w in _PROMPT_ROWS
)

# ---- search rows ------------------------------------------------------------------------

SEARCH_ROWS = f"""
SELECT 'site-' || CAST(k AS STRING) AS site_id, source, event_id AS row_no,
  CASE WHEN event_id % 29 = 28 THEN 'https://external.example.org/x' || CAST(event_id % 3 AS STRING)
    ELSE CASE event_id % 4 WHEN 0 THEN 'http://www.S' WHEN 1 THEN 'https://www.s' ELSE 'https://s' END || CAST(k AS STRING) || '.example.com'
      || CASE WHEN user_id % 17 = 16 THEN '/landing/' || CAST(user_id % 3 AS STRING) ELSE path END
      || CASE event_id % 3 WHEN 1 THEN '#part' WHEN 2 THEN CASE WHEN path = '/' THEN '' ELSE '/' END ELSE '' END END AS page,
  CAST(CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS DOUBLE) AS clicks,
  CAST(CASE WHEN event_type IN ('view', 'click') THEN 10 + event_id % 7 ELSE 0 END AS DOUBLE) AS impressions,
  CAST(event_id % 50 AS DOUBLE) / 4 AS ctr, CAST(event_id % 80 AS DOUBLE) / 8 AS position
FROM (
  SELECT event_id, user_id, event_type, k, {path_sql('j', 'k')} AS path,
    CASE WHEN event_id % 2 = 0 THEN 'search-console' ELSE 'bing-webmaster' END AS source
  FROM (
    SELECT event_id, user_id, event_type, user_id % 12 AS j, CAST(floor(user_id / 12) AS BIGINT) AS k FROM events) AS e) AS f"""

# ---- documents --------------------------------------------------------------------------

DOCUMENTS = """
SELECT doc_id, text
  || CASE doc_id % 7 WHEN 1 THEN chr(10) || 'We guarantee a better ranking.' || chr(13) || chr(10) || 'next'
       WHEN 2 THEN chr(10) || 'This is not a promise.' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || 'We ensure placement'
            || chr(10) || 'One more line' || chr(10) || '  You get #1 ranking and 45% more traffic increase  '
       WHEN 3 THEN chr(10) || 'Read a testimonial and the customer logo wall' || chr(10) || 'scrape consumer AI apps'
       WHEN 4 THEN chr(10) || 'see file:///tmp/x or C:/data' || chr(10) || 'robots.txt controls the host' || chr(10) || '下载量'
       WHEN 5 THEN chr(10) || '- uses: upload-artifact' || chr(10) || 'with:' || chr(10) || '  path: runs/latest' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  !runs/raw/**' ELSE '' END
       ELSE '' END AS text
FROM documents"""

DOC_FILES = """
SELECT 'docs/g' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING) || '/d' || CAST(doc_id AS STRING) || '.md' AS path, doc_id,
  '# Intro Part' || chr(10) || text || chr(10) || '## Setup & `Run` <b>now</b> ##' || chr(10) || 'See [next](d' || CAST(doc_id + 1 AS STRING)
  || '.md#intro-part) and ![pic](<../img/a b.png>)' || chr(10) || '## Intro Part' || chr(10)
  || CASE doc_id % 5 WHEN 0 THEN '[up](../../../out.md) [web](https://example.com) [self](#intro-part-1)'
       WHEN 1 THEN '[bad](%zz.md) [folder](../g' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING) || '?x=1 "title")'
       WHEN 2 THEN '[lost](./d' || CAST(doc_id AS STRING) || '.md#no-such-part)'
       ELSE '### Setup ' || CAST(doc_id % 2 AS STRING) END AS text
FROM documents"""


# ---- Spark side -------------------------------------------------------------------------

TABLES = "pages conversations documents events".split()


_scans: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _scans:
        _scans[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _scans[key]


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a derivation over the given tables; the views only live until the plan is resolved."""
    for name in TABLES:
        if f"FROM {name}" not in sql:
            continue
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def site_pages(spark, sf_dir) -> DataFrame:
    cols = ["site_id", "url", "status", "content_type", "fetch_error", "html"]
    return derived(spark, sf_dir, SITE_PAGES).select(*cols)


def _listed(c: str):
    return F.filter(F.split(c, "\\|"), lambda x: F.length(x) > 0)


def brands_of(spark, sf_dir, sql: str) -> DataFrame:
    df = derived(spark, sf_dir, sql)
    return df.select(
        "site_id", "name", "domain", "category", "one_liner", _listed("personas_s").alias("personas"),
        _listed("use_cases_s").alias("use_cases"), _listed("trusted_s").alias("trusted_domains"),
    )


def answers(spark, sf_dir) -> DataFrame:
    df = derived(spark, sf_dir, ANSWERS)
    none = F.lit(None).cast("boolean")

    def cite(c: str, owned):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("url"), F.lit(None).cast("string").alias("title"), owned.alias("owned"), none.alias("trusted")))

    given = F.when(F.col("conv_id") % 11 == 5, F.lit(False))
    cits = F.filter(F.array(cite("cit1", given), cite("cit2", none)), lambda c: c.isNotNull())
    return df.withColumn("citations", cits).drop("cit1", "cit2", "h", "k", "conv_id", "turn")
