"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest
from compare import check, oracle

import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, message = check(spark, con, sf_dir, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok, message


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_no_query_is_empty(sf_dir, name):
    """A match of nothing proves nothing: at the size of the comparison every SQL has rows."""
    found = oracle(sf_dir.replace("sf0.001", "sf0.01")).sql(f"SELECT count(*) FROM ({catalog.ORACLES[name]}) AS q").fetchall()
    assert found[0][0] > 0


def test_entry_without_the_training_data_queries(monkeypatch):
    """Any library that only those need may be missing; the other queries stay."""
    import importlib
    import sys

    for name in [n for n in sys.modules if n.startswith(("citeframe.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.warns(UserWarning, match="left out"):
        entry = importlib.import_module("__spark_entry__")
    assert entry.queries().keys() == catalog.QUERIES.keys() and entry.oracle_sql() == catalog.ORACLES
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("name", ["x1_scan_policies", "a7_aggregate_search", "a10_prompt_groups", "r_audit_issues", "d7_language_findings", "x5_doc_link_findings"])
def test_no_python_and_no_cartesian(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "MapInPandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_page_scan_is_the_only_python(spark, sf_dir):
    plan = catalog.QUERIES["p3_flags_given"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan and "MapInPandas" not in plan


def test_line_scan_does_not_shuffle(spark, sf_dir):
    from citeframe.operators.docscan import scan_policies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert "Exchange" not in scan_policies(docs)._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_trimmed_before_the_shuffle(spark, sf_dir):
    from citeframe.operators.crawl import plan_targets

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("split_part(url, '/', 3) AS site_id", "url")
    assert "WindowGroupLimit" in plan_targets(pages, 3)._jdf.queryExecution().executedPlan().toString()
