"""Runs that commit: a rerun changes nothing, a broken write is invisible, history reads what was written."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from citeframe.sources import sinks
from citeframe.sources.runs import read_runs


def tables(spark, n, extra=()):
    rows = [(f"s{k}", f"https://s{k}.example.com/", k) for k in range(n)]
    summary = [(f"s{k}", 50 + k, None, ["faq"], 3, 4, 2) for k in range(n)]
    return {
        "pages": spark.createDataFrame(rows, "site_id string, url string, page_rank int"),
        "audit_summary": spark.createDataFrame(summary, "site_id string, overall_score int, vavr int, missing_page_types array<string>, crawled_pages long, discovered_urls long, key_page_count long"),
        **dict(extra),
    }


def sites(spark):
    return spark.range(5).selectExpr("concat('s', id) AS site_id", "concat('https://s', id, '.example.com') AS base_url")


def test_rerun_and_other_runs(spark, tmp_path):
    root = str(tmp_path / "runs")
    sinks.write_audit(tables(spark, 4), sites(spark), root, "007", "2024-01-01T00:00:00Z")
    first = sorted(map(tuple, sinks.read_committed(spark, root, "pages").collect()))
    sinks.write_audit(tables(spark, 4), sites(spark), root, "007", "2024-01-01T00:00:00Z")
    assert sorted(map(tuple, sinks.read_committed(spark, root, "pages").collect())) == first and len(first) == 4
    assert first[0][-1] == "007"
    sinks.write_audit(tables(spark, 2), sites(spark), root, "a/b:c=1 d", "2024-02-01T00:00:00Z")
    sinks.write_audit(tables(spark, 1), sites(spark), root, "007", "2024-03-01T00:00:00Z")
    runs = read_runs(spark, root).collect()
    assert [(r.run_id, r.overall_score, r.site_label) for r in runs] == [
        ("007/s0", 50.0, "https://s0.example.com"), ("a/b:c=1 d/s0", 50.0, "https://s0.example.com"), ("a/b:c=1 d/s1", 51.0, "https://s1.example.com")
    ]
    assert runs[0].kind == "audit" and runs[0].artifact_count == 2


@pytest.mark.parametrize("table", ["bad", "manifests"])
def test_broken_write_is_invisible(spark, tmp_path, monkeypatch, table):
    root = str(tmp_path / "runs")
    sinks.write_audit(tables(spark, 2), sites(spark), root, "r", "2024-01-01T00:00:00Z")
    before = sorted(map(tuple, sinks.read_committed(spark, root, "pages").collect()))
    broken = spark.range(1).select(F.raise_error(F.lit("lost")).alias("x"))
    if table == "manifests":
        monkeypatch.setattr(sinks, "_commit", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_audit(tables(spark, 5, [("bad", broken)] if table == "bad" else []), sites(spark), root, "r", "2024-02-01T00:00:00Z")
    assert len(os.listdir(os.path.join(root, "pages", "_run=rr"))) >= 2
    assert sorted(map(tuple, sinks.read_committed(spark, root, "pages").collect())) == before
    assert [r.generated_at for r in read_runs(spark, root).collect()] == ["2024-01-01T00:00:00Z"] * 2
    assert sinks.commits(spark, str(tmp_path / "none")).count() == 0
