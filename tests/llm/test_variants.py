"""Spelling variants against all pairs of words and followed chains."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from citeframe.llm import queries, variants


def one_edit(a, b):
    """Whether one insertion, deletion or replacement leads from one word to the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute(words):
    """Each word against all words that share a word with one code point less, or itself."""
    by_less = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by_less[w[:k] + w[k + 1 :]].add(w)
        by_less[w].add(w)
    form, out = {}, {}
    for w, n in words.items():
        around = set().union(by_less[w], *(by_less[w[:k] + w[k + 1 :]] for k in range(len(w))))
        near = [x for x in around if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words[form[w]] if form[w] is not None else None))
    return rows


def as_set(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(brute_counts(docs))
    assert as_set(queries.op11(spark, sf_dir)) == want and any(r[1] for r in want)


def all_pairs(words):
    rows = {w: [x for x in words if one_edit(w, x)] for w in words}
    return {w: (len(near), min(near, key=lambda x: (-words[x], x))) for w, near in rows.items() if near}


@pytest.mark.parametrize("tile", [1024, 8, 1])
def test_near_words_equal_all_pairs(spark, tile):
    """Short alphabets make blocks dense; small tiles divide them down to single code points."""
    rnd = random.Random(tile)
    words = {"".join(rnd.choices("abc", k=rnd.randint(1, 7))): rnd.randint(1, 9) for _ in range(700)}
    words |= {"prefix" * 3 + "".join(rnd.choices("xyzé", k=3)): rnd.randint(1, 9) for _ in range(60)}
    words |= {"日本語" + c: 4 for c in "一二三四五"} | {"a" * k: k for k in range(1, 40)}
    got = variants.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), tile)
    rows = got.collect()
    assert {r.word: (r.n_near, r.best) for r in rows} == all_pairs(words)
    assert all(words[r.best] == r.best_n for r in rows) and len(rows) == len({r.word for r in rows})


def test_large_block_in_square_tiles(spark):
    """A third of all words in one block of one free code point, and very long words."""
    words = {"stem" + chr(0x4E00 + k) + "tail": k % 7 for k in range(600)} | {f"other{k:04d}": 3 for k in range(600)}
    words |= {"x" * 20_000 + c + "y" * 20_000: 5 for c in ("", "a", "b", "ab")}
    got = {r.word: (r.n_near, r.best) for r in variants.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["stem" + chr(0x4E00) + "tail"] == (599, "stem" + chr(0x4E00 + 6) + "tail")
    long = ["x" * 20_000 + c + "y" * 20_000 for c in ("", "a", "b", "ab")]
    assert [got[w][0] for w in long] == [2, 3, 3, 2]
    assert got["other0000"][0] == 9 + 9 + 5


def test_roots_of_long_chains(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("a", "b"), ("c", "b")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{k}": "w37" for k in range(37)} | {"a": "b", "c": "b"}


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (None, "Words words WORDS wordz"), (3, "ÀÉÎõü× àéîõü÷ ×÷×÷×"), (3, "ÀÉÎõü× àéîõü÷ ×÷×÷×"), (3, "ÀÉÎõü× àéîõü÷ ×÷×÷×"),
        (4, "wordz wordz 词 words1words_words"), (5, "z" * 5000 + " " + "z" * 4999), (5, "z" * 5000 + " " + "z" * 4999), (6, "z" * 5000 + " " + "z" * 4999),
    ]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n int")
    words = variants.word_counts(docs, change=variants.misspelt)
    assert {r.word: r.n for r in words.collect()} == brute_counts(rows)
    assert as_set(variants.variants(words)) == brute(brute_counts(rows))
    assert variants.variants(variants.word_counts(docs.limit(0))).count() == 0


def test_long_text_in_blocks(spark):
    rows = [(1, "Alpha betaa gamma, " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in variants.word_counts(docs, change=variants.misspelt).collect()} == brute_counts(rows)


def test_query_matches_sql(spark, sf_dir):
    from compare import check, oracle

    ok, message = check(spark, oracle(sf_dir), sf_dir, "op11", queries.op11, queries.ORACLES["op11_spelling_variants"])
    assert ok, message
