from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citeframe.functions import numbers as N
from citeframe.functions import text as T
from citeframe.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("url,expected", [
    ("HTTPS://Example.COM", "https://example.com/"),
    ("https://example.com/a/b///", "https://example.com/a/b"),
    ("https://example.com/a/#top", "https://example.com/a"),
    ("https://example.com/a/?q=1#x", "https://example.com/a?q=1"),
    ("https://example.com:443/a", "https://example.com/a"),
    ("http://example.com:80", "http://example.com/"),
    ("http://example.com:8080/", "http://example.com:8080/"),
    ("https://example.com/a/./b/../c", "https://example.com/a/c"),
    ("https://example.com/für x", "https://example.com/f%C3%BCr%20x"),
    ("https://example.com/a%20b", "https://example.com/a%20b"),
    ("not a url", "not a url"),
    ("https://example.com?x=1", "https://example.com/?x=1"),
])
def test_comparable_url(spark, url, expected):
    assert one(spark, U.comparable_url(F.lit(url))) == expected


@pytest.mark.parametrize("href,expected", [
    ("/x/", "https://a.com/x"), ("../up", "https://a.com/up"), ("y", "https://a.com/d/y"), ("//b.com/z", "https://b.com/z"),
    ("https://c.com", "https://c.com/"), ("#top", None), ("mailto:a@b", None), ("javascript:x()", None), ("", None), ("?q=2", "https://a.com/d/p?q=2"),
])
def test_absolute_url(spark, href, expected):
    assert one(spark, U.absolute_url(F.lit("https://a.com/d/p?q=1"), F.lit(href))) == expected


@pytest.mark.parametrize("value,expected", [
    ("http://www.Example.com/a/", "https://example.com/a"), ("https://example.com", "https://example.com/"), ("http://example.com/?a=1", "https://example.com/?a=1"),
])
def test_search_url(spark, value, expected):
    assert one(spark, U.search_url(F.lit(value))) == expected


def test_domains(spark):
    assert one(spark, U.url_domain(F.lit("WWW.Example.com"))) == "example.com"
    assert one(spark, U.url_domain(F.lit("https://docs.example.com:8443/x"))) == "docs.example.com"
    assert one(spark, U.domain_in(F.lit("docs.example.com"), F.lit("example.com"))) is True
    assert one(spark, U.domain_in(F.lit("notexample.com"), F.lit("example.com"))) is False


@pytest.mark.parametrize("text,expected,coverage", [
    ("alpha beta", "Alpha BETA gamma", 2 / 3), ("alphabet", "alpha", 1.0), ("x", "of the to", 1.0), ("", "word", 0.0), ("word", "word word", 1.0),
])
def test_keyword_coverage(spark, text, expected, coverage):
    assert one(spark, T.keyword_coverage(F.lower(F.lit(text)), F.lit(expected))) == pytest.approx(coverage)


def test_words_cut_and_slug(spark):
    assert one(spark, T.word_count(F.lit("v1.2 time-to-value 中文字 é"))) == 4
    assert one(spark, T.truncate(F.lit("x" * 181), 180)) == "x" * 177 + "..."
    assert one(spark, T.truncate(F.lit("x" * 180), 180)) == "x" * 180
    assert one(spark, T.clean_text(F.lit(" <b>a</b>\n\n b "), 20)) == "a b"
    assert one(spark, T.clean_text(F.lit(" <br> "), 20)) is None
    assert one(spark, T.slug(F.lit("FAQ schema: Q&A!"))) == "faq-schema-q-a"
    assert one(spark, T.glob_match(F.lit("https://x.com/Docs/a.b"), ["*/docs/?.b"])) is True
    assert one(spark, T.glob_match(F.lit("https://x.com/docs/ab"), ["/docs/*"])) is False


def test_numbers(spark):
    assert one(spark, N.round_percent(F.lit(0.125))) == 13 and one(spark, N.round_score(F.lit(0.125))) == 0.13
    assert [one(spark, N.rank_score(F.lit(r))) for r in (1, 2, 3, 4, 5, 9)] == [1.0, 0.75, 0.5, 0.25, 0.0, 0.0]
    assert one(spark, N.rank_score(F.lit(None).cast("int"))) is None
    got = [one(spark, N.csv_number(F.lit(v))) for v in ("", "8.3%", " 4 ", "-1", "NaN", "x", "1e3", "Infinity")]
    assert got == [0.0, 8.3, 4.0, None, None, None, 1000.0, None]
