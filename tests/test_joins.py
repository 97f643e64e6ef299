from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citeframe.operators import joins
from citeframe.operators.joins import lookup_join

FORCED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_hot_key_is_split_and_nothing_is_lost(spark, how):
    before = {k: spark.conf.get(k, None) for k in FORCED}
    try:
        for k, v in FORCED.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
        big = spark.range(0, 60_000, 1, 8).select("id", key.alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("pad"))
        hot = [] if how == "left_anti" else [("hot", 1)]
        lookup = spark.createDataFrame([*hot, *[(f"k{i}", i) for i in range(0, 50, 2)]], "key string, v int")
        got = lookup_join(big, lookup, ["key"], how)
        rows = [(r["id"],) for r in got.collect()]
        known = {r.key for r in lookup.collect()}
        keys = {i: "hot" if i % 3 == 0 else f"k{i % 50}" for i in range(60_000)}
        want = [i for i, k in keys.items() if how == "left" or (k in known) != (how == "left_anti")]
        assert sorted(r[0] for r in rows) == want
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_lookup_is_not_multiplied(spark):
    big, lookup = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    assert "Generate" not in lookup_join(big, lookup, ["k"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_measured_hot_keys_are_joined_apart(spark, how):
    """A key with 30 % of the rows, and none with 10 %, in small partitions: their rows are not shuffled, no other key's rows are repeated."""
    rows = [("hot", k) if k % 10 < 3 else (f"k{k % 4001}" if k % 7 else None, k) for k in range(40_000)]
    big = spark.createDataFrame(rows, "a string, n int").withColumn("b", F.lit(1)).repartition(40)
    lookup = spark.createDataFrame([("hot", 1, "x")] + [(f"k{k}", 1, "y") for k in range(3000)], "a string, b int, v string")
    assert len(joins.hot_keys(big, ["a", "b"])) == 2 and joins.hot_keys(big.where("a <> 'hot'"), ["a", "b"]) == []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, apart = (joins.lookup_join(big, lookup, ["a", "b"], how, measured=m) for m in (False, True))
        plan = apart._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, plain.collect())) == sorted(map(str, apart.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("broadcast") == 1 and "Union" in plan and "Generate" not in plan
