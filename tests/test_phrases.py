"""Names in texts by the index of their rarest pieces, against every name tried on every text."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from citeframe.operators.phrases import with_names


def found(spark, texts, names):
    t = spark.createDataFrame(texts, "site_id string, k int, text string")
    n = spark.createDataFrame([(s, o, x, x.lower()) for s, o, x in names], "site_id string, ord int, name string, needle string")
    rows = with_names(t, n, F.lower(F.coalesce("text", F.lit(""))), "found").collect()
    return {r.k: [(x.ord, x.name) for x in r.found] for r in rows}


def test_equals_all_names_tried(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcé ", k=rnd.randint(1, 7)))
    names = [(f"s{k % 3}", k, (word() + " " + word()).strip() or "x") for k in range(120)] + [("s0", 200, "A"), ("s0", 201, "b"), ("s1", 202, "日本"), ("s1", 203, "dup"), ("s1", 204, "dup")]
    texts = [(f"s{k % 4}", k, " ".join(word().upper() if rnd.random() < 0.3 else word() for _ in range(rnd.randint(0, 60)))) for k in range(150)]
    texts += [("s1", 900, "in 日本 and Dup"), ("s1", 901, None), ("s0", 902, "")]
    want = {k: [(o, n) for s2, o, n in sorted(names, key=lambda x: x[1]) if s2 == s and n.lower() in (t or "").lower()] for s, k, t in texts}
    assert found(spark, texts, names) == want and sum(map(len, want.values())) > 100
    assert found(spark, texts[:3], []) == {k: [] for _, k, _ in texts[:3]}


def test_a_site_with_100000_names(spark):
    """Many names that share their first words: seconds, not names times texts."""
    names = [("big", k, f"Vendor Number {k * 7919 % 100_003} Ltd") for k in range(100_000)] + [("small", 1, "Vendor")]
    texts = [("big", k, f"we compared vendor number {k * 31} ltd with vendor number {k} ltd " + "and others " * 50) for k in range(300)] + [("small", 999, "a vendor")]
    start = time.perf_counter()
    got = found(spark, texts, names)
    assert time.perf_counter() - start < 90
    by = {n: (o, n) for _, o, n in names if _ == "big"}
    for _, k, _ in texts[:300]:
        want = {by[x] for x in (f"Vendor Number {k * 31} Ltd", f"Vendor Number {k} Ltd") if x in by}
        assert set(got[k]) == want
    assert got[999] == [(1, "Vendor")]
