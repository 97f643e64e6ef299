"""Ranks inside groups: a site with half of all rows, nulls, ties of the first order column, and the plan."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from citeframe.operators.crawl import plan_targets
from citeframe.operators.ranks import ranked


def brute(rows):
    by = defaultdict(list)
    for g, a, b in rows:
        by[g].append((-a, b))
    return {(g, b): k + 1 for g, own in by.items() for k, (a, b) in enumerate(sorted(own))}


def test_hot_group_is_ranked_by_many_tasks(spark):
    rows = [("hot", k % 5, f"u{k:05d}") for k in range(20_000)] + [(f"g{k % 700}", k % 3, f"v{k}") for k in range(19_000)] + [(None, 1, f"w{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "g string, a int, b string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = df.repartitionByRange("g", F.desc("a"), "b").where("g = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        got = {(r.g, r.b): r.n for r in ranked(df, ["g"], [F.desc("a"), F.col("b")], "n").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(spread) >= 3 and max(r["count"] for r in spread) < 12_000
    assert got == brute(rows)
    assert ranked(df.limit(0), ["g"], [F.col("b")], "n").count() == 0


def test_plan_of_all_targets_has_no_window_over_a_site(spark):
    urls = spark.createDataFrame([("a", f"https://a.example.com/{w}/{k}") for w in ("docs", "blog", "pricing") for k in range(40)], "site_id string, url string")
    plan = plan_targets(urls)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_range" in line for line in windows)
    got = [(r.target_ord, r.url) for r in plan_targets(urls).orderBy("target_ord").collect()]
    limited = [(r.target_ord, r.url) for r in plan_targets(urls, 120).orderBy("target_ord").collect()]
    assert got == limited and len(got) == 120
