"""SimHash, sharding, mixing, quality and decontamination against brute force, and odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from citeframe.llm import decontaminate, mixing, quality, queries, sharding, simhash
from citeframe.llm.components import connected
from citeframe.session import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, fp string, shard string"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"w{i % 997}x" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n ", None, None, 3), (4, "one", "en", "b", 3),
        (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (None, "two words", None, None, 9), (5, long_text, "en", "a", 1),
        (6, long_text, "en", "c", 1), (7, "One two THREE four", "en", "c", 1), (8, "one two three four", "en", "c", 1),
    ]
    return [(*r, "x", 1, "y", "z") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """Smallest index of each index's component, all pairs compared."""
    arr, label = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(arr)):
        for j in np.nonzero(np.bitwise_count(arr ^ arr[i]) <= 3)[0]:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(arr))]


def test_simhash_query(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{fp:016x}", docs[c].doc_id) for r, fp, c in zip(docs, fps, components(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10(spark, sf_dir).collect()}
    assert got == want


@pytest.fixture
def broadcasts(spark, request):
    """A larger broadcast fails, whatever Spark took the table's size for."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", request.param)
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("broadcasts", ["2m"], indirect=True)
def test_simhash_query_broadcasts_no_keys_or_rows(spark, tmp_path, broadcasts):
    """Few enough fingerprints for Spark to broadcast them, with 32 times as many keys."""
    rnd, texts = random.Random(12), []
    for _ in range(3000):
        texts.append(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(12)))
        if rnd.random() < 0.2:
            texts.append(texts[-1].upper())
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fps = [brute_fingerprint(t) for t in texts]
    want = {i: (f"{fp:016x}", c) for i, (fp, c) in enumerate(zip(fps, components(fps), strict=True))}
    found = queries.op10(spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found.collect()} == want


def test_divided_buckets_are_not_broadcast(spark, monkeypatch):
    """Files of parts are far smaller than their rows, so that Spark would broadcast them."""
    plans, rnd = [], random.Random(13)
    monkeypatch.setattr(simhash, "stage", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or stage(df, name))
    fps = {1 << rnd.randrange(63) | 1 << rnd.randrange(63) for _ in range(40)}
    simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 6)
    members = [plan for name, plan in plans if name == "simhash-members"]
    assert len(members) > 1 and not any("Broadcast" in plan for plan in members)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_links_connect_what_is_near(spark, bucket):
    """Random balls: many fingerprints around a few centres, some buckets far above the limit."""
    rnd, fps = random.Random(5), set()
    for _ in range(4):
        centre = rnd.getrandbits(64)
        weak = rnd.sample(range(64), 9)
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in weak if rnd.random() < 0.4) ^ (1 << rnd.randrange(64) if rnd.random() < 0.3 else 0))
    fps = sorted(fps | {rnd.getrandbits(64) for _ in range(200)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    label = {r.node: r.label for r in connected(simhash.links(frame, bucket)).collect()}
    want = components(fps)
    groups = {}
    for s, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, 130), (130, 129), (7, 7)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(100, 131), -5], -5)}


def test_simhash_odd_rows(spark, odd, empty):
    rows, classes = simhash.near_duplicates(odd)
    got = rows.join(classes, "fp")
    assert got.count() == len(odd_rows())
    by_id = {r["id"]: r.component_id for r in got.collect()}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[6] == 5 and by_id[8] == 7 and by_id[None] is None
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]
    assert simhash.one_of_each(empty).count() == 0


def brute_overlap(texts):
    """All pairs of different five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    return sets, [
        (i, j) for j in range(len(sets)) for i in range(j) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ]


def test_overlap_stage_joins_what_is_alike(spark, empty):
    """Edited copies at a similarity around 0.8, copies, chains and short texts; the pipeline keeps one of each component."""
    rnd, texts = random.Random(8), [None, "", "one", "ONE", "two words", "a b c d e", "a b c d e f"]
    for _ in range(30):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 400))]
        for _ in range(4):
            texts.append(" ".join(words))
            for _ in range(max(1, len(words) // rnd.choice([40, 60, 100]))):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    sets, pairs = brute_overlap(texts)
    assert len(pairs) > 30
    label = list(range(len(texts)))
    for i, j in pairs + [(sets.index(s), j) for j, s in enumerate(sets)]:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert corpus_pipeline.without_near_duplicates(spark, empty, "").count() == 0


def test_overlap_odd_rows(spark, odd):
    kept = corpus_pipeline.without_near_duplicates(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]


def test_sharding_law(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op3(spark, sf_dir).collect()))


def test_hypergeometric_has_its_law(spark):
    """Mean and variance of many draws, and a small law in full."""
    n, total, good, draws = 4000, 900, 300, 120
    x = sharding.hypergeometric(*(F.lit(v).cast("long") for v in (total, good, draws)), sharding.uniform("id"))
    got = np.array([r[0] for r in spark.range(n).select(x).collect()])
    p = good / total
    variance = draws * p * (1 - p) * (total - draws) / (total - 1)
    assert abs(got.mean() - draws * p) < 5 * (variance / n) ** 0.5 and abs(got.var() / variance - 1) < 0.15
    small = sharding.hypergeometric(*(F.lit(v).cast("long") for v in (4, 2, 2)), sharding.uniform("id"))
    freq = Counter(r[0] for r in spark.range(n).select(small).collect())
    assert abs(freq[1] / n - 4 / 6) < 0.04 and abs(freq[0] / n - 1 / 6) < 0.03 and set(freq) == {0, 1, 2}


def test_matrix_sums(spark):
    counts = [(i, (i * 37) % 50) for i in range(1100)] + [(40_000, 5000)]
    rows = sharding.matrix(spark.createDataFrame(counts, "part long, n long"), 8, 3).collect()
    assert {r.part: sum(r.gives) for r in rows} == dict(counts)
    sums = np.array([r.gives for r in rows]).sum(axis=0)
    assert (np.array([r.gives for r in rows]) >= 0).all() and sums.max() - sums.min() <= 1


def test_sharding_odd_rows(odd, empty):
    got = sharding.sharded(odd)
    assert got.columns == [*("shard_in" if c == "shard" else c for c in odd.columns), "shard", "slot"]
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and Counter(r.shard for r in rows) == {k: 2 if k < 3 else 1 for k in range(8)}
    assert sharding.sharded(empty).count() == 0


def test_mixing_laws(spark, odd, empty, sf_dir):
    rows = queries.op1(spark, sf_dir).collect()
    text = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        source = text[r.doc_id].source
        assert r.size == len(WORD.findall(text[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        target[source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows()) and sum(r.taken for r in got) > 0
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0


def test_prefix_sums_over_levels(spark):
    """Deep prefixes, so that offsets come from two levels, and a group with nearly all rows."""
    from citeframe.llm.prefix import running

    rows = spark.range(3000).selectExpr("id", "if(id % 50 = 0, 'b', 'a') AS g", "md5(cast(id AS string)) AS key", "id % 7 AS v")
    got = {r["id"]: r.start for r in running(rows, "g", "key", "v", 4, ["id"]).collect()}
    sums = Counter()
    for r in sorted(rows.collect(), key=lambda r: r.key):
        assert got[r["id"]] == sums[r.g]
        sums[r.g] += r.v


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op7(spark, sf).collect() if r.doc_id in labels]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    good, bad = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("held out", len(held), right, auc)
    assert right > 0.9 and auc > 0.9


def test_interactions_in_linear_time():
    """The sum-of-squares identity against all pairs."""
    rows = [quality.describe(t, quality._Words()) for t in ("a b c d", "one TWO three", "")]
    model = quality.fit(rows, np.array([1, 0, 1], np.float32))
    ids, x, starts = model.inputs(rows)
    got = model.raw(ids, x, starts)[0]
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
        own, val = ids[a:b], x[a:b]
        pairs = sum(float(model.v[own[i]] @ model.v[own[j]]) * val[i] * val[j] for i in range(len(own)) for j in range(i))
        assert abs(model.b + model.w[own] @ val + pairs - got[k]) < 1e-3


def test_quality_odd_rows(spark, odd, empty):
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (7, 0), (7, 1)], "doc_id long, quality int")
    model = quality.train(odd, marks)
    scores = [r[0] for r in odd.select(quality.score(model, odd["text"])).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(scores) == len(odd_rows())
    assert quality.train(empty, marks) is None
    assert quality.keep_good(empty, marks).columns == empty.columns
    assert quality.keep_good(odd, marks.limit(0)).count() == len(odd_rows())


def brute_leaks(docs, items):
    """Pairs with the item's words in one run, or most of its shingles."""
    out = set()
    for d, text in docs:
        grams = decontaminate.shingles(decontaminate.words(text), 5)
        for i, item in items:
            own = decontaminate.shingles(decontaminate.words(item), 5)
            if own and len(own & grams) / len(own) > 0.7:
                out.add((d, i))
    return out


def test_decontamination_finds_leaks(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op8(spark, sf).collect()}
    assert got == brute_leaks(docs, items)


def test_wand_returns_all_above_threshold():
    rnd = random.Random(3)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rnd.randint(3, 25)))) for i in range(300)]
    index = decontaminate.Index(items)
    for _ in range(200):
        terms = sorted({index.terms[t] for t in rnd.choices(vocabulary, k=40) if t in index.terms})
        want = Counter()
        for t in terms:
            for d, x in zip(index.docs[t], index.impacts[t], strict=True):
                want[d] += x
        want = {d: s for d, s in want.items() if s >= decontaminate.THRESHOLD}
        got = dict(index.search(terms))
        assert got.keys() == want.keys() and all(abs(got[d] - s) < 1e-9 for d, s in want.items())


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "one two three four"), (None, "What is this? It is one."), (3, "one two three four"), (9, "??")],
        "item_id long, text string",
    )
    hits = decontaminate.contaminated(odd, items)
    assert Counter((r.doc_id, r.item_id) for r in hits.collect()) == {(7, 3): 2, (8, 3): 2}
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows()) - 2
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    spread_out = decontaminate.contaminated(odd, items.unionByName(items), "doc_id", "text")
    assert spread_out.count() == 8


def test_hits_do_not_depend_on_how_items_are_dealt(spark):
    """Items in several indexes have the shares and passages that they have in one."""
    rnd = random.Random(9)
    vocabulary = [f"t{i}" for i in range(80)]
    weights = [1 / (k + 1) for k in range(80)]
    bags = [rnd.choices(vocabulary, weights, k=rnd.randint(8, 40)) for _ in range(40)]
    items = [(i, " ".join(b[:-4]) + "? " + " ".join(b[-4:]) + ".") for i, b in enumerate(bags)]
    items += [(40, None), (41, "?!"), (5, items[5][1])]
    docs = [(d, " ".join(rnd.choices(vocabulary, weights, k=30) + b[: rnd.randint(len(b) // 2, len(b))] + b[-4:])) for d, b in enumerate(bags)]
    table = spark.createDataFrame(items, "item_id long, text string")

    def found(size):
        indexes = [b.value for b in decontaminate.indexes(table, size=size)]
        rows = [(d, h["item_id"], round(h["score"], 9), h["question"], h["answer"]) for x in indexes for d, t in docs for h in x.hits(t)]
        return len(indexes), sorted(rows)

    one, want = found(10**6)
    several, got = found(1000)
    assert one == 1 and several > 3 and len(want) > 20 and got == want
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r[0], r[1], round(r[2], 9), r[3], r[4]) for r in decontaminate.contaminated(frame, table, size=1000).collect()) == want
    assert decontaminate.contaminated(frame, table.where("item_id = 41"), size=1).count() == 0


def test_items_inside_running_text_without_spaces(spark):
    """Chinese and Thai items quoted within a passage, and passages that only share their letters."""
    items = [(1, "水在标准大气压下的沸点是多少摄氏度？一百摄氏度。"), (2, "เมืองหลวงของประเทศไทยคืออะไร กรุงเทพมหานคร")]
    other = "今天的天气很好，我们一起去公园散步，然后回家做饭。"
    docs = [(1, other * 3 + items[0][1] + other * 2), (2, "ข้อความ" + items[1][1] + "ต่อไป"), (3, other * 9), (4, items[0][1][::-1] + other), (5, "mixed 英文 text " + items[0][1] + " and more words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    hits = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(1, 1), (2, 2), (5, 1)}
    assert decontaminate.words("Ab_1 水x") == ["ab_1", "水", "x"]
