"""Metadata checks on texts of unusual length."""

from __future__ import annotations

from citeframe.operators.metadata import mixed_language


def test_a_sentence_of_any_length_is_found_whole(spark):
    """Tens of thousands of words in one sentence, and six as the fewest."""
    long = "This " + "  word ".join(["x"] * 40_000)
    texts = [long, "中文 Use a b c d e f 后面 The a b c d e", "Not a b c d e", None]
    rows = [("s", f"https://s.example.com/zh/{k}", t) for k, t in enumerate(texts)] + [("s", "https://s.example.com/en/0", long)]
    found = mixed_language(spark.createDataFrame(rows, "site_id string, url string, site_text string")).collect()
    assert {(r.url[-4:], r.detail) for r in found} == {("zh/0", long), ("zh/1", "Use a b c d e f")}
