"""Headings of documents: numbers of repeats, and time that grows with the number of headings."""

from __future__ import annotations

import random
import time
from collections import Counter

from citeframe.operators.docscan import heading_anchors


def test_repeats_are_numbered_in_document_order(spark):
    rnd = random.Random(4)
    names = [rnd.choice(["a", "b", "a b", "c-1", "c", "zz"]) for _ in range(400)]
    text = "\n".join(f"{'#' * rnd.randint(1, 6)} {n}\ntext" for n in names)
    rows = heading_anchors(spark.createDataFrame([("x", text), ("y", ""), ("z", None), ("w", "## one")], "path string, text string")).collect()
    got = {r.line_no: (r.slug, r.repeat_no, r.anchor) for r in rows if r.path == "x"}
    seen, want = Counter(), {}
    for k, n in enumerate(names):
        slug = n.replace(" ", "-")
        want[2 * k + 1] = (slug, seen[slug], slug if not seen[slug] else f"{slug}-{seen[slug]}")
        seen[slug] += 1
    assert got == want and [r.anchor for r in rows if r.path != "x"] == ["one"]


def test_many_headings_take_linear_time(spark):
    """100,000 headings of one document, all alike or all different."""
    heading_anchors(spark.createDataFrame([("x", "# a")], "path string, text string")).collect()
    for text in ("# same\n" * 100_000, "".join(f"# h{k}\n" for k in range(100_000))):
        start = time.perf_counter()
        assert heading_anchors(spark.createDataFrame([("x", text)], "path string, text string")).count() == 100_000
        assert heading_anchors(spark.createDataFrame([("x", text)], "path string, text string")).agg({"repeat_no": "max"}).first()[0] in (0, 99_999)
        assert time.perf_counter() - start < 40
