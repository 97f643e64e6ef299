"""Language labels: sums against all paths, held-out accuracy, mixed texts and odd rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from citeframe.llm import languages, queries


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")


@pytest.fixture(scope="module")
def field(docs):
    return languages.train(docs)


def brute_marginals(chain, table, ids, first):
    """All labellings of a short row of words, weighed one by one."""
    n = table.shape[1]
    out = np.zeros((len(ids), n))
    for path in itertools.product(range(n), repeat=len(ids)):
        w = 1.0
        for t, y in enumerate(path):
            w *= table[ids[t], y] * (chain.start[y] if first[t] else chain.moves[path[t - 1], y])
        for t, y in enumerate(path):
            out[t, y] += w
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_marginals_equal_all_paths_however_words_are_cut(chunk):
    rnd = np.random.default_rng(chunk)
    field = languages.Field(["a", "b", "c"], {})
    field.moves, field.first = rnd.normal(size=(3, 3)), rnd.normal(size=3)
    chain, table = languages.Chain(field), languages.emissions(rnd.normal(size=(5, 3)) * 3)
    ids, first = rnd.integers(0, 5, 8), np.array([1, 0, 0, 0, 1, 1, 0, 0], bool)
    got = np.concatenate([p for _, p in chain.marginals(table, ids, first, chunk)])
    assert np.allclose(got, brute_marginals(chain, table, ids, first))


def test_blocks_of_chunks_agree(monkeypatch):
    rnd = np.random.default_rng(3)
    field = languages.Field(["a", "b"], {})
    field.moves = rnd.normal(size=(2, 2))
    chain, table, ids = languages.Chain(field), languages.emissions(rnd.normal(size=(9, 2))), rnd.integers(0, 9, 5000)
    first = rnd.random(5000) < 0.01
    whole = np.concatenate([p for _, p in chain.marginals(table, ids, first, 5000)])
    monkeypatch.setattr(languages, "CHUNKS", 3)
    parts = list(chain.marginals(table, ids, first, 17))
    assert len(parts) > 50 and np.allclose(np.concatenate([p for _, p in parts]), whole)


def test_features_do_not_depend_on_neighbours():
    words = ["a", "été", "x" * 3000, "straße", "ok", "日"]
    ids, of = languages.features(words)
    for k, w in enumerate(words):
        alone, _ = languages.features([w])
        assert sorted(alone.tolist()) == sorted(ids[of == k].tolist())
        grams = sum(max(len(w) + 3 - g, 0) for g in languages.GRAMS)
        assert len(alone) == 1 + 2 * min(languages.AFFIX, len(w)) + grams


def test_held_out_accuracy(spark, sf_dir, docs, field):
    want = {r.doc_id: (zlib.crc32(str(r.doc_id).encode()) % 4 == 2, r.lang) for r in docs.select("doc_id", "lang").collect()}
    got = queries.op12(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert len(got) == len(want) and all(r.held_out == want[r.doc_id][0] and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id][1] for r in held) >= 0.97 * len(held)


def test_held_out_rows_and_other_columns_are_not_learnt(spark, docs, field):
    changed = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end as lang", "'s' as source")
    other = languages.train(changed)
    assert other.languages == field.languages and np.array_equal(other.weights, field.weights) and np.array_equal(other.moves, field.moves)


def test_switches_are_found(docs, field):
    rnd = random.Random(2)
    by = {}
    for r in docs.select("doc_id", "lang", "text").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            by.setdefault(r.lang, []).extend(languages.WORD.findall(r.text))
    right = total = 0
    for _ in range(60):
        a, b = rnd.sample(sorted(by), 2)
        words = [by[x][(at := rnd.randrange(len(by[x]) - 30)) : at + 30] for x in (a, b)]
        text = " ".join(words[0] + words[1])
        found = languages.predict(field, [text], spans=True)[0][2]
        border = len(" ".join(words[0]))
        for m in languages.WORD.finditer(text):
            label = next(x for s, e, x in found if s <= m.start() < e)
            right += label == (a if m.start() < border else b)
            total += 1
    assert right >= 0.93 * total
    assert np.all(np.diag(field.moves) >= field.moves.max(axis=1))


def test_odd_rows(spark, field):
    rows = [(1, None), (2, ""), (3, "123 -- ²³ _"), (4, "日本"), (5, "the " * 400_000 + "end"), (6, "the of and with that"), (6, "the of and with that"), (None, "der die nicht einer")]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = [r.found for r in frame.select(languages.language(field, frame["text"], spans=True).alias("found")).collect()]
    assert [r.lang for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert got[4].lang == "en" and got[4].spans[0].start == 0 and got[4].spans[-1].end == 1_600_003
    assert got[5] == got[6] and got[5].lang == "en" and got[7].lang == "de"
    assert frame.limit(0).select(languages.language(field, frame["text"])).count() == 0


def test_without_labelled_rows(spark):
    frame = spark.createDataFrame([(1, "some text", None), (None, None, "en")], "doc_id long, text string, lang string")
    assert languages.train(frame) is None
    got = frame.select(languages.language(None, frame["text"]).alias("f")).collect()
    assert [(r.f.lang, r.f.score) for r in got] == [("und", 0.0)] * 2


def test_one_language_and_tiny_samples(spark):
    frame = spark.createDataFrame([(None, "uno dos tres", "es"), (None, "uno dos", "es")], "doc_id long, text string, lang string")
    field = languages.train(frame)
    assert field.languages == ["es"] and languages.predict(field, ["dos"])[0][:2] == ("es", 1.0)
