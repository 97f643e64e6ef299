"""Token alignment against whole texts encoded at once and groups cut by sets of offsets."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeframe.llm import alignment, queries

FIRST, SECOND = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
FIXED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "\n", "\n\n x", " x", "x ", "a\r\nb", "a;\r\n b", "x\t \t y", "a b  c\n  d", "<|endoftext|> it's <s> </s> <unk> <0x0A>",
    "naïve ▁ piece", "日本語の文章です。これは長い", "👩‍👩‍👧 zz\x00y", "ﬁ ① é   x　y   z\x1c \x1f w", "don't  can't 's", "a" * 3000,
    "x" + "​" * 40, "ไทยภาษา ภาษาไทย", "1234567890 3.14 $%^&*", "tab\tsep\tvalues\n\tindented\n",
    "a,b.c;d:e!f?g(h)[i]{j}<k>l=m+n-o_p*q/r\\s|t~u^v`w@x#y$z%a&b\"c'd", "foo(bar), 'baz'\" (qux) x(), y[0].z a², ½. Ⅷ; e\u0301, é!",
    "don't we'll I'm they've it'd you're 'tis s's", " ,x", "(", "x\t,y", "x \n,y\n.z", "中文,中文。中文 (中)",
]


@pytest.fixture(scope="module")
def pair():
    with open(FIRST, "rb") as f, open(SECOND, "rb") as g:
        return alignment.Pair(f.read(), g.read())


def brute_groups(pair, text):
    """Whole text at once; groups end where both sides have a token end."""
    if not text:
        return []
    a = pair.first.encode(" " + text, add_special_tokens=False).ids
    b = pair.second.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.first_bytes[i] for i in a) != raw or b"".join(pair.second_bytes[i] for i in b) != raw:
        return []
    ends_a, ends_b = np.cumsum([len(pair.first_bytes[i]) for i in a]), np.cumsum([len(pair.second_bytes[i]) for i in b])
    groups, at_a, at_b = [], 0, 0
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        to_a, to_b = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        groups.append((a[at_a:to_a], b[at_b:to_b]))
        at_a, at_b = to_a, to_b
    return groups


def brute(pair, rows):
    """Rows (doc_id, *FIXED) by plain dictionaries."""
    found = [(i, brute_groups(pair, t)) for i, t in rows]
    held = Counter()
    for _, groups in found:
        held.update({(x, y) for a, b in groups for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for i, groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        sums = sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), *sums, sha))
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", *FIXED).collect())


def test_query(spark, sf_dir, pair):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op13(spark, sf_dir)) == Counter(brute(pair, docs))


@pytest.mark.parametrize("known", [0, 7, alignment.KNOWN])
def test_odd_rows_and_pairs_outside_the_known_ones(spark, pair, known):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "it's x"), (3, "it's x"), (None, "it's x y")]
    docs = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, row string, n_a int")
    got = alignment.align(docs, FIRST, SECOND, known=known, with_groups=True)
    assert got.columns[:4] == ["doc_id", "text", "row", "n_a_in"]
    assert rows_of(got) == Counter(brute(pair, rows))
    for r in got.collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, FIRST, SECOND).count() == 0


def test_long_text_in_blocks(spark, pair):
    text = "\n".join(f"wörd{i % 313} and  more, it's {i % 97}" for i in range(60_000))
    assert len(text) > alignment._LONG_TEXT
    docs = spark.createDataFrame([(1, text), (2, "and more"), (3, text[:999])], "doc_id long, text string")
    rows = [(1, text), (2, "and more"), (3, text[:999])]
    assert rows_of(alignment.align(docs, FIRST, SECOND)) == Counter(brute(pair, rows))


def test_pointer_jumping_labels_components():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        n = int(rnd.integers(1, 60))
        ends = [np.unique(np.append(rnd.integers(1, n + 1, rnd.integers(1, n + 1)), n)) for _ in range(2)]
        last = alignment.label(*ends)
        common = np.intersect1d(*ends)
        want = np.concatenate([np.searchsorted(common, e) for e in ends])
        assert np.array_equal(np.unique(last, return_inverse=True)[1], want)


def test_counts_grow_with_rows(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(9)], "doc_id long, text string")
    out = alignment.align(docs, FIRST, SECOND)
    assert out.where(F.col("count_sum") != 9 * F.col("n_links")).count() == 0
