"""Threshold edges of the rules on small sites."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from citeframe.operators.features import page_features
from citeframe.operators.rules import audit_issues
from citeframe.plans.audit import run_audit
from citeframe.schemas import schema
from citeframe.session import stage
from citeframe.sources.site_files import parse_robots, parse_sitemaps, reachable_sitemaps, read_pages

BASE = "https://a.example.com"


def words(n):
    return " ".join(["word"] * n)


def page(path, body, head="<title>A descriptive page title here</title><meta name='description' content='d'>", status=200, error=None):
    return ("a", BASE + path, status, "text/html", error, f"<html><head>{head}</head><body><h1>Heading</h1> {body}</body></html>")


def issues_of(spark, rows, **dims):
    sites = spark.createDataFrame([("a", BASE)], schema("sites"))
    pages = page_features(spark.createDataFrame(rows, schema("pages_raw")), sites)
    got = audit_issues(stage(pages, "t"), sites, **dims).select("rule_id", "page_url", "severity").collect()
    return {(r.rule_id, (r.page_url or "").removeprefix(BASE)): r.severity for r in got}


SECTIONS = "<h2>What?</h2> <h2>How?</h2> "


def test_word_and_title_edges(spark):
    got = issues_of(spark, [
        page("/pricing", words(148)), page("/security", words(149)),
        page("/faq", words(78)), page("/compare", words(79)), page("/integrations", words(10) + "<ul><li>x</li></ul>"),
        page("/docs", words(200), head="<title>" + "t" * 19 + "</title>"), page("/product", words(200), head="<title>" + "t" * 20 + "</title>"),
    ])
    assert got[("R12", "/pricing")] == "warn" and ("R12", "/security") not in got
    assert got[("R12", "/faq")] == "info" and ("R12", "/compare") not in got and ("R12", "/integrations") not in got
    assert ("R08", "/docs") in got and ("R08", "/product") not in got
    assert ("R09", "/docs") in got and ("R33", "") in got


def test_evidence_groups_and_severity(spark):
    got = issues_of(spark, [page("/pricing", "nothing to see"), page("/docs", "api guide"), page("/security", "<ul><li>sso</li></ul>"), page("/compare", "x")])
    assert got[("R24", "/pricing")] == "warn" and got[("R26", "/docs")] == "info"
    assert ("R25", "/security") not in got and got[("R27", "/compare")] == "warn"


def test_faq_structure_rules(spark):
    faq = '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":{"name":"Unseen thing entirely?","acceptedAnswer":[{"text":"Missing reply sentence"}]}}</script>'
    got = issues_of(spark, [page("/faq", faq + words(100))])
    assert {"R18", "R19", "R22", "R29"} <= {r for r, p in got if p == "/faq"}
    got = issues_of(spark, [page("/faq", faq + SECTIONS + words(100) + " Unseen thing entirely? Missing reply sentence")])
    assert not {"R18", "R19", "R21", "R22", "R29"} & {r for r, p in got if p == "/faq"}


def test_failed_pages_raise_only_that(spark):
    got = issues_of(spark, [page("/pricing", "", status=0), page("/security", "", status=404, error="HTTP 404")])
    assert {r for r, p in got if p == "/pricing"} - {"R46"} == {"R05"} and ("R05", "/security") in got


def test_script_heavy_and_noindex(spark):
    scripts = "<script>1</script>" * 5
    got = issues_of(spark, [page("/pricing", scripts + words(100)), page("/docs", words(200), head="<meta name='robots' content='NOINDEX'>")])
    assert ("R14", "/pricing") in got and ("R06", "/docs") in got and ("R07", "/docs") in got


def test_links_self_generic_and_supported(spark):
    got = issues_of(spark, [
        page("/", '<a href="/pricing/">more</a> <a href="/security"><b>Security</b></a> <a href="/">self</a>'),
        page("/pricing", words(200)), page("/security", words(200)), page("/docs", words(200)),
    ])
    assert ("R47", "/pricing") in got and ("R48", "/pricing") in got and ("R46", "/pricing") in got
    assert not {"R46", "R47", "R48"} & {r for r, p in got if p == "/security"}
    assert ("R46", "/docs") in got and ("R47", "/docs") not in got and ("R37", "/") in got


def test_invariants(spark, sf_dir):
    from catalog.registry import brands, competitors, sites
    from catalog import derive as D

    out = run_audit(D.site_pages(spark, sf_dir), sites(spark, sf_dir), D.derived(spark, sf_dir, D.ROBOTS), brands(spark, sf_dir), competitors(spark, sf_dir))
    rows = out["bucket_scores"].collect()
    assert len(rows) == 5 * sites(spark, sf_dir).count() and all(0 <= r.score <= 100 for r in rows)
    assert sum(r.error_count + r.warn_count + r.info_count for r in rows) == out["issues"].count()
    assert out["issues"].select("issue_seq", "site_id").distinct().count() == out["issues"].count()


def test_hot_site_keeps_every_row(spark):
    rows = [page(f"/pricing/{i}", words(10)) for i in range(60)] + [("b", f"https://b.example.com/pricing/{i}", 200, "text/html", None, "<h1>x</h1>") for i in range(3)]
    sites = spark.createDataFrame([("a", BASE), ("b", "https://b.example.com")], schema("sites"))
    pages = page_features(spark.createDataFrame(rows, schema("pages_raw")), sites)
    got = audit_issues(pages, sites).filter("rule_id = 'R12'").groupBy("site_id").count().collect()
    assert {r.site_id: r["count"] for r in got} == {"a": 60, "b": 3}


@pytest.mark.parametrize("text,blocked_all,bots", [
    ("User-agent: *\nDisallow: /", True, []), ("Disallow: /", True, []), ("User-agent: *\nDisallow: /private", False, []),
    ("User-agent: PerplexityBot\nUser-agent: OAI-SearchBot\nDisallow: /", False, ["OAI-SearchBot"]),
    ("User-agent: perplexitybot\nDisallow: /", False, []), ("", False, []),
    ("User-agent: PerplexityBot\r\nDisallow: /\r\nUser-agent: OAI-SearchBot\r\nDisallow: /", False, ["OAI-SearchBot", "PerplexityBot"]),
])
def test_robots(spark, text, blocked_all, bots):
    row = parse_robots(spark.createDataFrame([("a", text)], schema("robots_raw")))[0].first()
    assert (row.blocked_all, row.blocked_bots, row.exists) == (blocked_all, bots, bool(text.strip()))


def test_nested_sitemaps_with_a_loop(spark):
    index = "<sitemapindex>{}</sitemapindex>"
    entry = "<sitemap><loc>%s/%s.xml</loc></sitemap>"
    rows = [
        ("a", f"{BASE}/sitemap.xml", index.format(entry % (BASE, "one"))), ("a", f"{BASE}/one.xml", index.format(entry % (BASE, "two") + entry % (BASE, "sitemap"))),
        ("a", f"{BASE}/two.xml", index.format(entry % (BASE, "three"))), ("a", f"{BASE}/three.xml", index.format(entry % (BASE, "four"))),
        ("a", f"{BASE}/four.xml", "<urlset><url><loc>https://a.example.com/x</loc></url></urlset>"), ("a", f"{BASE}/stray.xml", "<urlset/>"),
    ]
    sites = spark.createDataFrame([("a", BASE)], schema("sites"))
    reached = reachable_sitemaps(spark.createDataFrame(rows, schema("sitemaps_raw")), sites)
    assert reached.count() == 5 and [r.loc for r in parse_sitemaps(reached)[0].collect()] == [f"{BASE}/x"]


def test_read_html_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name in ("index.html", "pricing.html", "docs/index.html", "docs/a.html", "notes.txt"):
        (tmp_path / name).write_text("<h1>x</h1>")
    got = read_pages(spark, str(tmp_path), BASE, "a")
    assert sorted(r.url for r in got.collect()) == [f"{BASE}/", f"{BASE}/docs", f"{BASE}/docs/a", f"{BASE}/pricing"]
    assert got.filter(F.col("site_id") != "a").count() == 0


def test_redirects_meet_all_stored_pages_and_only_text_is_admitted(spark):
    from citeframe.plans.audit import fetched_pages

    def refresh(to):
        return f"<html><head><meta http-equiv='refresh' content='0; url={to}'></head><body></body></html>"

    rows = [
        ("a", BASE + "/", 200, "text/html", None, refresh("/en")), ("a", BASE + "/en", 200, "text/html", None, "<p>en</p>"),
        ("a", BASE + "/file", 200, "application/pdf", None, "%PDF"), ("a", BASE + "/go", 200, "text/html", None, refresh("/file")),
        ("a", BASE + "/down", 0, "application/octet-stream", "reset", None), ("a", BASE + "/old", 200, "text/html", None, refresh("/gone")),
    ]
    raw = spark.createDataFrame(rows, schema("pages_raw"))
    sites = spark.createDataFrame([("a", BASE)], schema("sites"))
    got = fetched_pages(raw, raw.where(~F.col("url").endswith("/en")).select("site_id", "url"), sites).collect()
    assert {(r.url.removeprefix(BASE), r.status) for r in got} == {("/en", 200), ("/down", 0), ("/gone", 404)}


def test_whole_audit_parses_once_and_never_shuffles_html(spark, sf_dir, monkeypatch):
    """Every staged plan of an audit: one page scan in all, and no exchange with the html column."""
    from catalog import derive as D
    from catalog.registry import sites
    from citeframe.plans import audit as A

    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(A, "stage", noted)
    out = A.run_audit(D.site_pages(spark, sf_dir), sites(spark, sf_dir), D.derived(spark, sf_dir, D.ROBOTS), sitemaps_raw=D.derived(spark, sf_dir, D.SITEMAPS))
    assert sum("MapInArrow" in p for p in plans) == 1
    scan = next(p for p in plans if "MapInArrow" in p)
    assert "Exchange" not in scan and not any(re.search(r"\bhtml#\d", p) for p in plans if p is not scan)
    assert out["pages"].where("status = 404").count() > 0


@pytest.mark.parametrize("max_pages", [1, 3, None])
def test_whole_audit_plans_resolves_and_reports_absent_pages(spark, max_pages):
    """The smaller side decides how wide rows meet the plan; the rows are the same either way."""
    shim = "<html><head><meta http-equiv='refresh' content='0; url=/pricing/now'></head><body></body></html>"
    rows = [page(f"/blog/{k}", words(9)) for k in range(30)] + [page("/", words(9)), page("/pricing/now", words(9))]
    rows += [("a", BASE + "/docs", 200, "text/html", None, shim)]
    locs = "".join(f"<url><loc>{BASE}{p}</loc></url>" for p in ["/", "/docs", "/gone/docs", *(f"/blog/{k}" for k in range(30))])
    sites = spark.createDataFrame([("a", BASE)], schema("sites"))
    sitemaps = spark.createDataFrame([("a", BASE + "/sitemap.xml", f"<urlset>{locs}</urlset>")], schema("sitemaps_raw"))
    out = run_audit(spark.createDataFrame(rows, schema("pages_raw")), sites, sitemaps_raw=sitemaps, max_pages=max_pages)
    got = {(r.url.removeprefix(BASE), r.status, r.page_rank) for r in out["pages"].select("url", "status", "page_rank").collect()}
    want = {"/"} if max_pages == 1 else {"/", "/pricing/now", "/gone/docs"} if max_pages == 3 else {"/", "/pricing/now", "/gone/docs"} | {f"/blog/{k}" for k in range(30)}
    assert {u for u, _, _ in got} == want and len(got) == len(want)
    if max_pages != 1:
        ranks = {u: r for u, _, r in got}
        assert ranks["/pricing/now"] == ranks["/gone/docs"]  # the shim's place, not the one of its own path
        assert {u: s for u, s, _ in got}["/gone/docs"] == 404
        assert out["issues"].where(F.col("rule_id") == "R05").select("page_url").collect()[0][0] == BASE + "/gone/docs"
    assert out["audit_summary"].first().discovered_urls == (max_pages or 33)
