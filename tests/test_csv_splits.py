"""CSV records over many splits against the one-task reader."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citeframe.sources.csv_splits import read_table
from citeframe.sources.search_csv import read_search_csv

COLUMNS = ["page", "clicks", "impressions", "ctr", "position"]


def write(folder, name, header, rows, eol="\n"):
    def cell(x):
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x

    (folder / name).write_bytes(("\ufeff" + eol.join([header, *(",".join(map(cell, r)) for r in rows)]) + eol).encode())


def sample(seed, n):
    """Rows whose quoted fields hold line breaks, quotes, commas and whole fake records."""
    rnd = random.Random(seed)
    texts = ["plain", "a,b", 'say ""x""', "two\nlines", "1,2,3\n4,5,6\n", '"', "é\n\n\nü", "x" * 300 + "\n" + "y" * 300]
    return [[f"https://a.example.com/{k}?{rnd.choice(texts)}", str(k), str(rnd.randint(0, 9)), "1%", "2"] for k in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(3))
def test_many_splits_equal_one_task(spark, tmp_path, small_splits, seed):
    rows = [sample(seed, 400), sample(seed + 50, 3), sample(seed + 99, 150)]
    for k, own in enumerate(rows):
        write(tmp_path, f"part-{k}.csv", "Page, CLICKS,impressions,ctr,position", own, "\r\n" if k == 2 else "\n")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got, unclosed = read_table(spark, str(tmp_path), COLUMNS)
    want = [r for own in rows for r in own]
    assert [[r[c] for c in COLUMNS] for r in got.orderBy("row_no").collect()] == want
    assert sorted(r.row_no for r in got.select("row_no").collect()) == list(range(len(want))) and unclosed.count() == 0
    for k, own in enumerate(rows):
        one = spark.read.csv(str(tmp_path / f"part-{k}.csv"), header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        assert [list(r) for r in one.collect()] == own


def test_headers_differ_by_file_blank_lines_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("clicks,page,impressions,ctr,position,more\n\n1,https://a.example.com/x,2,3%,4,z\n   \n5,https://a.example.com/y,6,7,8\n")
    (tmp_path / "b.csv").write_text('page,"clicks",impressions,ctr,position\n"https://a.example.com/z",9,1,2,3')
    good, bad = read_search_csv(spark, str(tmp_path), "s", "bing-webmaster")
    assert [(r.row_no, r.page[-1], r.clicks) for r in good.orderBy("row_no").collect()] == [(0, "x", 1.0), (1, "y", 5.0), (2, "z", 9.0)] and bad.count() == 0
    (tmp_path / "c.csv").write_text("page,clicks\n")
    with pytest.raises(ValueError, match="impressions"):
        read_search_csv(spark, str(tmp_path), "s", "bing-webmaster")


def test_a_quote_that_is_never_closed_is_one_reject(spark, tmp_path, small_splits):
    rows = [f"https://a.example.com/{k},1,2,3,4" for k in range(300)]
    rows[100] = 'https://a.example.com/100,"1,2,3,4'
    (tmp_path / "a.csv").write_text("\n".join(["page,clicks,impressions,ctr,position", *rows]) + "\n")
    good, bad = read_search_csv(spark, str(tmp_path), "s", "bing-webmaster")
    assert good.count() == 100 and [(r.row_no, r.reason) for r in bad.collect()] == [(100, "quote is never closed")]
    assert good.agg(F.max("row_no")).first()[0] == 99


def test_records_are_parsed_once_and_stay_where_they_are(spark, tmp_path):
    """Filters and columns behind the parse do not repeat it, and no join brings a file's rows together."""
    from citeframe.sources.search_csv import read_search_csv

    rows = [("page,clicks,impressions,ctr,position,note")]
    rows += [f'https://a.example.com/{k},{k},2,5%,1,"said ""x""{chr(10) if k % 3 == 0 else " "}end"' for k in range(300)]
    rows += ["no url,1,1,1,1,", "https://a.example.com/b,many,1,1,1,", ""]
    (tmp_path / "a.csv").write_text("\n".join(rows))
    good, bad = read_search_csv(spark, str(tmp_path), "s", "bing-webmaster")
    assert [r.clicks for r in good.orderBy("row_no").collect()] == [float(k) for k in range(300)]
    assert {(r.row_no, r.reason) for r in bad.collect()} == {(300, "page is no url"), (301, "clicks is no number of 0 or more")}
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_csv(") <= 2, plan  # one in each branch of the union, or one above it
    assert plan.count("RLIKE(trim(") <= 3 * 4 * plan.count("from_csv("), plan
    shuffles = [x for x in good._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert shuffles and all("record" in x for x in shuffles)
