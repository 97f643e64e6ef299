"""Bloom filters: no key is lost, most others are left out, and the size stays bounded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from citeframe.operators import bloom


def test_stored_keys_are_found_and_most_others_not(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) as key", "id % 7 as part")
    found = bloom.bloom_of(keys, ["key", "part"])
    probe = spark.range(40_000).selectExpr("concat('k', id) as key", "id % 7 as part", "id < 20000 as stored")
    counts = {r.stored: r.n for r in probe.where(found.may_hold("key", "part")).groupBy("stored").agg(F.count("*").alias("n")).collect()}
    assert counts[True] == 20_000 and counts.get(False, 0) < 800


def test_empty_null_and_bounded(spark, monkeypatch):
    none = bloom.bloom_of(spark.createDataFrame([], "key string"), ["key"])
    probe = spark.createDataFrame([(None,), ("a",)], "key string")
    assert probe.where(none.may_hold("key")).count() == 0
    assert probe.where(bloom.bloom_of(probe, ["key"]).may_hold("key")).count() == 2
    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 16)
    small = bloom.bloom_of(spark.range(100_000).selectExpr("id as key"), ["key"])
    assert len(small.words) * 64 == 1 << 16 and small.words.dtype == np.uint64
    assert spark.range(100_000).where(small.may_hold("id")).count() == 100_000
