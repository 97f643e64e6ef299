from __future__ import annotations

import re
import time

import pytest
from citeframe.operators.extract import scan_page


def test_unclosed_tags_and_script_text():
    p = scan_page('<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>'
                  "<body><p><b>one<br><p>two<ul><li>x<li>y</ul><noscript>no</noscript><!-- c --></body></html>")
    assert p["title"] == "A & B"
    assert p["body_text"] == "onetwoxy"
    assert (p["lists"], p["scripts"]) == (1, 1)


def test_heading_context_prefers_the_nearest_container():
    p = scan_page('<body><h2>Far</h2><section><div><h3>Near</h3></div><p>See <a href="/x">this page</a> now</p></section>'
                  '<td>cell <a href="/y" aria-label="Label"></a></td></body>')
    x, y = p["raw_links"]
    assert (x["text"], x["block"], x["heading"]) == ("this page", "See this page now", "Near")
    assert (y["text"], y["aria"], y["block"], y["heading"]) == ("", "Label", "cell", "Far") or y["block"] == "cell "


def test_list_item_ends_at_the_next_item():
    p = scan_page('<body><ul><li>first <a href="/1">a</a><li>second <a href="/2">b</a></ul>')
    assert [link["block"] for link in p["raw_links"]] == ["first a", "second b"]


def test_controls_and_head_tags():
    p = scan_page('<head><meta name="robots" content="NoIndex"><meta name="googlebot" content="nofollow"><link rel="canonical" href=" https://a/ ">'
                  '<meta property="og:title" content="t"><link rel="alternate" hreflang="en" href="/en/"></head>'
                  '<body><button>x</button><div role="button" aria-label="y"></div><input aria-label="z"></body>')
    assert (p["controls"], p["aria_controls"]) == (3, 2)
    assert p["robots_meta"] == "noindex nofollow" and p["canonical"] == "https://a/"
    assert p["alternates"] == [{"hreflang": "en", "href": "/en/"}]


def test_jsonld_graph_order_and_malformed_blocks():
    p = scan_page('<script type="application/ld+json">{"@type":"A","@graph":[{"@type":"B","@graph":{"@type":"C"}},{"@type":"D"}]}</script>'
                  '<script type="application/ld+json">{bad</script><script type="application/ld+json">[1,{"@type":"E"}]</script>')
    assert [n.split('"@type": "')[1][0] for n in p["jsonld_nodes"]] == ["A", "B", "D", "C", "E"]
    assert p["jsonld_depths"] == [0, 1, 1, 2, 0] and p["jsonld_invalid"] == 1


def test_text_without_body_tag_and_empty_input():
    assert scan_page("plain <b>text</b>")["body_text"] == "plain text"
    assert scan_page(None)["body_text"] == "" and scan_page("")["title"] == ""


def test_broken_pages_are_scanned_whole():
    """Odd declarations, an open comment, deep or broken JSON-LD and half surrogates never raise."""
    from citeframe.operators.extract import scan_page

    for html in ("<p>a</p><![foo bar]>", "<p>a</p><![ foo", "", None):
        scan_page(html)
    assert "unclosed" not in scan_page("<p>a</p><!-- unclosed <p>b")["body_text"]
    for block in ("[" * 100_000, '{"a":"\\ud800x"}', "{"):
        scan_page(f'<script type="application/ld+json">{block}</script>')["body_text"].encode()


HOSTILE = {
    "unmatched end tags": ("<b>", "</i></i>"), "spans and blocks": ("<span>", "<div></div>"), "nested lists": ("<ul><li><a href=a>b</a>", ""),
    "headings under spans": ("<span>", "<h2>x</h2>"), "open links": ("<a href=x>yy", ""), "paragraph below": ("<span>", "<p></p>"),
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    """Four times the tags take far less than sixteen times the seconds."""
    first, then = HOSTILE[kind]

    def seconds(n):
        page, best = "<p><li>" + first * n + then * n, float("inf")
        for _ in range(2):
            start = time.perf_counter()
            scan_page(page)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(16_000) < 9 * seconds(4_000) + 0.2


def test_long_texts_of_links_keep_what_is_shown():
    """What is cut from a very long block would not have been shown."""
    block = "<b> x</b>" * 3000 + " < y" * 3000 + "z>" * 5
    whole = scan_page(f"<p>{block}<a href=q>l</a></p>")
    link = whole["raw_links"][0]
    clean = lambda t: " ".join(re.sub("<[^>]+>", " ", t).split())[:200]
    text = re.sub("</?b>", "", block)
    assert clean(link["block"]) == clean(text) and len(link["block"]) < len(text)


def test_a_tag_that_ends_far_behind_is_no_text_of_a_link():
    """What is kept of a long block ends before the first mark that a later one may close, so it cleans as the whole does."""
    clean = lambda t: " ".join(re.sub("<[^>]+>", " ", t).split())[:200]
    for far in (150, 700, 2000):
        block = "start &lt; one " + "word " * far + "&lt; two " + "word " * 2000 + "&gt;" + " rest" * 500
        link = scan_page(f"<p>{block}<a href=q>l</a></p>")["raw_links"][0]
        assert clean(link["block"]) == ("start" + " rest" * 500)[:200]


def test_texts_around_many_links_are_held_once(spark, monkeypatch):
    """A block's text is one object for all its links, and a portion ends once its parts grow large."""
    import tracemalloc

    import pyarrow as pa
    from citeframe.operators import extract

    pages = spark.createDataFrame([], "id long, html string")
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, schema: run)
    cell = "".join(f'<a href="/t/{k}">topic number {k}</a> ' for k in range(300))
    html = [f"<h1>{k}</h1><table><tr><td>{cell}</td></tr></table>" for k in range(40)]
    assert list(extract.portions(pa.array(html))) == [(0, 40)]
    run = extract.extract_pages(pages)
    batch = pa.RecordBatch.from_pydict({"id": range(40), "html": html})
    got, most = [], 0
    tracemalloc.start()
    try:
        for out in run(iter([batch])):
            most = max(most, out.nbytes)
            got += zip(out.column("id").to_pylist(), out.column("h1").to_pylist())
        objects = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [(k, str(k)) for k in range(40)]
    assert objects < 16e6 and most < 8e6


def test_pages_are_scanned_in_small_portions(spark):
    """No more rows or html than a portion's are held as parts at once, and all rows come out, in order."""
    import pyarrow as pa
    from citeframe.operators.extract import PORTION_BYTES, PORTION_ROWS, extract_pages, portions

    sizes = [10] * (2 * PORTION_ROWS + 5) + [PORTION_BYTES // 2 + 1] * 3 + [3 * PORTION_BYTES, None, 0, 7]
    html = pa.array([None if n is None else "x" * n for n in sizes])
    cut = list(portions(html))
    assert [k for start, n in cut for k in range(start, start + n)] == list(range(len(sizes)))
    for start, n in cut:
        assert n <= PORTION_ROWS and (n == 1 or sum(x or 0 for x in sizes[start : start + n]) <= PORTION_BYTES)
    assert list(portions(html.slice(3, 4))) == [(0, 4)] and not list(portions(html.slice(0, 0)))

    rows = [(k, None if k % 50 == 7 else f"<h1>t{k}</h1>") for k in range(1000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        got = extract_pages(spark.createDataFrame(rows, "id long, html string").coalesce(1)).select("id", "h1").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [(r.id, r.h1) for r in got] == [(k, "t%d" % k if h else "") for k, h in rows]


def test_rows_of_one_file_part_are_dealt_over_tasks(spark):
    """One row group, or one hot site, is no single task: pages are dealt by their place before the scan."""
    from citeframe.operators.extract import extract_pages, spread
    from citeframe.operators.features import page_features
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("s", "https://s.example.com/", f"<h1>t{k}</h1>") for k in range(800)], "site_id string, url string, html string").coalesce(1)
    pages = one.selectExpr("site_id", "url", "200 AS status", "'text/html' AS content_type", "cast(null AS string) AS fetch_error", "html")
    sites = spark.createDataFrame([("s", "https://s.example.com")], "site_id string, base_url string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (extract_pages(spread(pages)), page_features(pages, sites)):
            got = df.select("h1", F.spark_partition_id().alias("task")).collect()
            assert sorted(r.h1 for r in got) == sorted(f"t{k}" for k in range(800))
            sizes = [sum(r.task == t for r in got) for t in {r.task for r in got}]
            assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_scanned_pages_are_not_shuffled_for_their_site(spark, tmp_path):
    """The size of a derived site table is known before the plan is made, so scanned parts stay where they are."""
    from citeframe.operators.features import with_site
    from pyspark.sql import functions as F

    html = "x" * 2000
    wide = spark.range(20000).select((F.col("id") % 50).cast("string").alias("site_id"), F.concat(F.lit(html), F.md5(F.col("id").cast("string"))).alias("html"))
    wide.selectExpr("*", "concat(html, md5(html)) AS more").write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    # a derivation whose size the optimizer cannot tell
    sites = pages.groupBy("site_id").agg(F.max(F.concat(F.lit("https://s"), "site_id", F.lit(".example.com"))).alias("base_url"))
    plan = with_site(pages, sites)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_squash_and_compact_keep_their_results(spark):
    from citeframe.functions import text as T
    from pyspark.sql import functions as F

    texts = ["a  b", " a\tb\n", "a  b", "a b", "", "　a﻿", "é  è", "~!  !~", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.squash(F.col("t")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == ["a b", "a b", "a b", "a b", "", "a", "é è", "~! !~", None]
    listed = spark.createDataFrame([([" 1", "1", "1 ", "\t", "2", " 1", "3", "2", "4"],)], "v array<string>")
    assert listed.select(T.compact(F.col("v")).alias("v")).first().v == ["1", "2", "3"]


def test_parts_held_by_a_worker_do_not_follow_the_rows_of_a_batch(spark, monkeypatch):
    """Python objects at the peak of a scan are those of one portion, with few or many rows in an Arrow batch."""
    import tracemalloc

    import pyarrow as pa
    from citeframe.operators.extract import extract_pages

    pages = spark.createDataFrame([], "id long, html string")
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, schema: run)
    links = "".join(f'<p>text {k} <a href="/a{k}">link {k}</a></p>' for k in range(4))
    run = extract_pages(pages, keep_site_text=True)

    def peak(rows):
        batch = pa.RecordBatch.from_pydict({"id": range(rows), "html": [f"<h1>{k}</h1>{links}" for k in range(rows)]})
        tracemalloc.start()
        try:
            got = [(i, h) for out in run(iter([batch])) for i, h in zip(out.column("id").to_pylist(), out.column("h1").to_pylist())]
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert got == [(k, str(k)) for k in range(rows)]
        return most

    few, many = peak(512), peak(2560)
    assert many < 2 * few
