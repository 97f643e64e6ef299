"""Exact figures of answer consensus and search validation."""

from __future__ import annotations

import json

import pytest

from citeframe.operators import answers as A
from citeframe.plans.evaluation import evaluate
from citeframe.plans.search_validation import validate_search
from citeframe.schemas import schema
from citeframe.sources.answers import read_answers
from citeframe.sources.dimensions import load_dimensions
from citeframe.sources.runs import read_runs
from citeframe.sources.search_csv import read_search_csv
from pyspark.sql import functions as F

GOOD = "Acme is a workflow automation platform. Acme keeps teams aligned. We recommend it."


def frame(spark, name, rows):
    return spark.createDataFrame(rows, schema(name))


def dims(spark):
    return {
        "brands": frame(spark, "brands", [("a", "Acme", "acme.com", "workflow automation platform", "Acme keeps teams aligned", ["ops"], ["rollout"], ["docs.net"])]),
        "facts": frame(spark, "brand_facts", [("a", 1, "f", "t", "Encryption protects accounts")]),
        "competitors": frame(spark, "competitors", [("a", 1, "Rival", None, None)]),
        "prompts": frame(spark, "prompts", [
            ("a", "p1", 1, "c", "t", "mention_or_recommend", "high", None, False, None), ("a", "p2", 2, "c", "t", "brand_accuracy", "medium", None, None, "en"),
            ("a", "h", 3, "c", "t", "other", None, None, True, None),
        ]),
    }


def answer(i, prompt, text, sample=0, rank=None, cits=(), mode="manual-import", provider="openai", locale=None):
    return ("a", "r1", i, prompt, sample, provider, "m", text, locale, rank, mode, [(u, None, None, None) for u in cits])


def run(spark, rows):
    d = dims(spark)
    return evaluate(frame(spark, "answers", rows), d["prompts"], d["brands"], d["facts"], d["competitors"],
                    spark.createDataFrame([], "site_id string, run_id string, generated_at string"))


def test_weighted_position_and_coverage(spark):
    out = run(spark, [
        answer(0, "p1", GOOD, rank=1), answer(1, "p1", GOOD, sample=1, rank=2), answer(2, "p1", GOOD, sample=2),
        answer(3, "p2", GOOD, rank=2), answer(4, "p2", GOOD, sample=1, rank=2), answer(5, "p2", "nothing", sample=2),
        answer(6, "h", GOOD),
    ])
    s = out["eval_summary"].first()
    # p1: median(1, .75) = .875 -> .88; p2: .75; (.88 * 1.5 + .75) / 2.5 = .828
    assert s.competitive_position_score == 0.83 and s.rank_coverage_rate == 67
    assert (s.prompt_count, s.holdout_prompt_count, s.sample_count) == (2, 1, 7)
    assert (s.repeated_prompt_count, s.stable_prompt_rate, s.unstable_prompt_count) == (2, 50, 1)
    assert s.mention_rate == 100 and s.vavr == 0 and s.locale == "en"
    groups = {r.prompt_id: r for r in out["prompt_groups"].collect()}
    assert groups["p1"].competitive_position_score == 0.88 and groups["p1"].stable
    assert groups["p2"].unstable_signals == ["mention", "accurate mention", "recommendation"] and groups["p2"].consensus_rate == 88
    assert groups["p2"].mention == 1


def test_ties_lose_and_providers_keep_order(spark):
    out = run(spark, [answer(0, "p1", GOOD, provider="zeta"), answer(1, "p1", "x", sample=1, provider="alpha")])
    g = out["prompt_groups"].first()
    assert (g.mention, g.provider, g.sample_count) == (0, "zeta, alpha", 2) and g.accuracy == pytest.approx(0.5, abs=0.01)


def test_citations_gaps_and_competitors(spark):
    out = run(spark, [
        answer(0, "p1", GOOD, cits=["https://www.acme.com/x"]), answer(1, "p1", GOOD, sample=1, cits=["https://api.docs.net"]),
        answer(2, "p1", GOOD, sample=2, cits=["https://notacme.com"]), answer(3, "p1", "Rival wins", sample=3), answer(4, "p1", "Acme.", sample=4),
    ])
    rows = {r.sample_index: r for r in out["citation_gaps"].collect()}
    assert [rows[i].owned_citation for i in range(3)] == [True, False, False] and rows[1].trusted_citation
    assert rows[2].citation_gap and not rows[0].citation_gap and rows[2].citation_domains == ["notacme.com"]
    assert rows[3].competitor_excluded and rows[3].competitor_mentions == ["Rival"] and rows[4].misrepresented
    assert rows[1].raw_payload_file == "openai/p1--sample-2.json" and rows[0].raw_payload_file == "openai/p1.json"
    t = out["citation_gap_totals"].first()
    assert (t.citation_gap_count, t.competitor_exclusion_gap_count, t.misrepresentation_count) == (1, 1, 1)


def test_rejects(spark):
    out = run(spark, [answer(0, "p1", GOOD), answer(1, "nope", GOOD), answer(2, "p1", GOOD, sample=1, rank=1, mode="eval"), answer(3, "p1", GOOD, sample=2, rank=0)])
    assert out["unknown_prompts"].count() == 1 and out["illegal_ranks"].count() == 2 and out["answer_scores"].count() == 1


def test_given_citation_flags_win(spark):
    d = dims(spark)
    rows = [("a", "r1", 0, "p1", 0, "o", "m", GOOD, None, None, "eval", [("https://acme.com", None, False, True)])]
    c = A.explode_citations(A.score_citations(frame(spark, "answers", rows), d["brands"])).first()
    assert (c.owned, c.trusted, c.domain) == (False, True, "acme.com")


def test_import_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"provider": "w", "responses": [
        {"promptId": "p1", "answerText": "x", "citations": ["https://a.com", {"url": "https://b.com", "owned": True}], "rankPosition": 2},
        {"promptId": "p2"}, {"promptId": "p3", "answerText": "y", "rankPosition": 1.5}, {"answerText": "z"}]}))
    (tmp_path / "two.json").write_text("{}")
    good, bad = read_answers(spark, str(tmp_path), "a", "r", "en")
    row = good.first()
    assert good.count() == 1 and (row.provider, row.locale, row.rank_position, len(row.citations)) == ("w", "en", 2, 2)
    assert sorted(r.reason for r in bad.collect()) == ["answerText is missing", "no array of responses", "promptId is missing", "rankPosition is no positive integer"]


def test_search_export(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text('﻿Page,CTR,Clicks,Impressions,Position\n"https://www.acme.com/pricing/",8.3%,2,10,3\nhttps://acme.com/pricing#x,5,"1",30,7\n'
                    "https://acme.com/docs,,0,0,\nhttps://acme.com/lost,1,1,5,1\nhttps://other.org/,1,1,5,1\nhttps://acme.com/bad,x,1,1,1\nnot a url,1,1,1,1\n")
    rows, bad = read_search_csv(spark, str(path), "a", "search-console")
    assert bad.count() == 2 and rows.count() == 5
    sites = frame(spark, "sites", [("a", "https://acme.com")])
    pages = spark.createDataFrame([("a", "https://acme.com/pricing", "pricing", 1), ("a", "https://acme.com/docs", "docs", 5), ("a", "https://acme.com/faq", "faq", 3)],
                                  "site_id string, url string, page_type string, page_rank int")
    issues = spark.createDataFrame([("a", "https://acme.com/pricing", "warn", "T1", "i1", 1), ("a", "https://acme.com/pricing", "error", "T2", "i2", 2)],
                                   "site_id string, page_url string, severity string, title string, issue_id string, issue_seq int")
    out = validate_search(rows, pages, issues, sites, "search-console")
    s = out["search_summary"].first()
    assert (s.imported_page_count, s.matched_page_count, s.out_of_scope_page_count) == (4, 2, 1)
    assert (s.key_pages_with_evidence, s.key_pages_without_evidence, s.total_impressions) == (1, 2, 45.0)
    pricing = out["search_pages"].filter("matched_page_type = 'pricing'").first()
    assert (pricing.clicks, pricing.impressions, pricing.page) == (3.0, 40.0, "https://acme.com/pricing#x")
    assert pricing.ctr == pytest.approx((83 + 150) / 40) and pricing.highest_severity == "error"
    kinds = sorted(r.finding_id for r in out["search_findings"].collect())
    assert [k.split("https")[0] for k in kinds] == [
        "search-console-audit-blockers-", "search-console-no-evidence-docs-", "search-console-no-evidence-faq-", "search-console-not-crawled-"]


def test_dimensions_and_runs(spark, tmp_path):
    rows = {"brands": {"site_id": "a", "name": "N", "domain": "d", "category": "c", "one_liner": "o"}, "brand_facts": {"site_id": "a", "fact_id": "f", "fact_type": "t", "text": "x"},
            "competitors": {"site_id": "a", "name": "R"}, "prompts": {"site_id": "a", "prompt_id": "p", "category": "c", "template": "t", "expected_signal": "s", "priority": "urgent"}}
    for name, row in rows.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text(json.dumps(row))
    with pytest.raises(ValueError, match="priority"):
        load_dimensions(spark, str(tmp_path))
    got = load_dimensions(spark, str(tmp_path), strict=False)
    assert got["brands"].first().personas == [] and got["prompts_rejects"].count() == 1 and got["prompts"].count() == 0
    for run_id, day in (("r1", 1), ("r2", 2), ("r3", 3)):
        (tmp_path / "runs" / run_id).mkdir(parents=True)
        doc = {"kind": "audit", "generatedAt": f"2024-01-0{day}", "site": {"input": "i"}, "summary": {"overallScore": 50 if day == 1 else None}, "artifacts": ["x"]}
        (tmp_path / "runs" / run_id / "run.json").write_text("{" if day == 3 else json.dumps(doc))
    (tmp_path / "runs" / "r2" / "share-summary.json").write_text(json.dumps({"metrics": {"overallScore": 70, "vavr": 5}}))
    runs = read_runs(spark, str(tmp_path / "runs")).collect()
    assert [(r.run_id, r.overall_score, r.vavr) for r in runs] == [("r2", 70.0, 5.0), ("r1", 50.0, None)]


def test_diff_of_first_run_is_null(spark):
    from citeframe.operators.consensus import eval_diff
    from citeframe.constants import DIFF_METRICS

    names = [n for n, _ in DIFF_METRICS]
    df = spark.createDataFrame([("a", "r10", *range(10)), ("a", "r2", *range(1, 11))], ["site_id", "run_id", *names])
    runs = spark.createDataFrame([("a", "r10", "2024-02-01"), ("a", "r2", "2024-01-01")], ["site_id", "run_id", "generated_at"])
    got = eval_diff(df, runs).filter(F.col("metric_ord") == 0).orderBy("run_id").collect()
    assert [(r.run_id, r.previous, r.delta) for r in got] == [("r10", 1, -1), ("r2", None, None)]
