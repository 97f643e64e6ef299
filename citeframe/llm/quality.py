"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text are its hashed words (log counts, unit length) and statistics of its structure (length, word
length, shares of capitals, digits, marks, repeats and so on), standardised and also as bins. The machine adds to
the linear score the pairwise interactions of all features through vectors of ``RANK`` numbers. They are summed in
linear time: sum over pairs of <v_i, v_j> x_i x_j = half the difference of the squared sum and the sum of squares.

It is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id among those whose
crc32(id as text) mod 5 is not 0; each is used with its whole text. Language, source and id are no inputs.
Every row is scored in place, without a shuffle.

Defined cases: a null text counts as empty and gets the score of empty texts. Without labelled rows all scores are
0.5. Labels with a null id or quality are passed over, several labels of one id are averaged. Repeated rows are
scored alike; a null id is never held out. Extra columns are kept as they are.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS = 6000
BUCKETS = 1 << 13
RANK = 8
BINS = 8
THRESHOLD = 0.3
EPOCHS = 12
DESCRIBED = T.StructType(
    [T.StructField("stats", T.ArrayType(T.FloatType())), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.FloatType()))]
)
_ROWS = 512


class _Words(dict):
    """Word to bucket; remembers words it has met, within bounds."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = bucket = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return bucket


def _classes() -> np.ndarray:
    """Byte to kind: lower, capital, digit, blank, line end, each mark of ASCII, part of a longer character."""
    kind = np.zeros(256, np.int64)
    kind[128:] = 1
    for char, k in [(range(65, 91), 2), (range(48, 58), 3), ((32, 9), 4), ((10, 13), 5), (range(97, 123), 6)]:
        kind[list(char)] = k
    marks = [b for b in range(33, 127) if kind[b] == 0]
    kind[marks] = 7 + np.arange(len(marks))
    return kind


_KIND = _classes()
_KINDS = int(_KIND.max()) + 1
STATS = _KINDS + 10


def describe(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, buckets and weights of a whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=_KINDS) if len(raw) else np.zeros(_KINDS, np.int64)
    tokens = [words[w] for w in text.split()]
    ids = np.array(tokens, np.int64)
    n, size = len(ids), max(len(raw), 1)
    unique, counts = np.unique(ids, return_counts=True)
    stats = np.zeros(STATS, np.float32)
    stats[:_KINDS] = np.sqrt(kinds / size)
    lines = kinds[5] + 1
    if n:
        marks = kinds[7:].sum()
        stats[_KINDS:] = (
            np.log1p(size), np.log1p(n), np.log1p(lines), size / n, n / lines, len(unique) / n, counts.max() / n,
            (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0, marks / n, kinds[2] / n,
        )
    weight = np.log1p(counts).astype(np.float32)
    if n:
        weight /= np.sqrt((weight**2).sum())
    return stats, unique.astype(np.int32), weight


@F.arrow_udf(DESCRIBED)
def _described(texts: pa.Array) -> pa.Array:
    words = _Words()
    rows = [describe(t.as_py(), words) for t in texts]
    return pa.array(
        [{"stats": s, "ids": i, "weights": w} for s, i, w in rows],
        pa.struct([("stats", pa.list_(pa.float32())), ("ids", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))]),
    )


class Model:
    """Weights of the machine; ``w`` linear, ``v`` vectors, ``b`` offset."""

    def __init__(self, mean, scale, edges, seed=7):
        self.mean, self.scale, self.edges = mean, scale, edges
        size = BUCKETS + STATS + STATS * (BINS + 1)
        self.w = np.zeros(size, np.float32)
        self.v = (np.random.default_rng(seed).standard_normal((size, RANK)) * 0.05).astype(np.float32)
        self.b = np.float32(0)

    def inputs(self, rows):
        """Feature numbers and values of several texts, one after the other, and where each begins."""
        ids, values, starts, at = [], [], [], 0
        span = np.arange(STATS)
        for stats, words, weights in rows:
            z = np.clip((stats - self.mean) / self.scale, -3, 3)
            bins = (stats[:, None] > self.edges).sum(axis=1)
            ids += [words, BUCKETS + span, BUCKETS + STATS + span * (BINS + 1) + bins]
            values += [weights, z / 4, np.full(STATS, 0.25, np.float32)]
            starts.append(at)
            at += len(words) + 2 * STATS
        return np.concatenate(ids).astype(np.int64), np.concatenate(values).astype(np.float32), np.array(starts)

    def raw(self, ids, x, starts):
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.w[ids] * x, starts)
        return self.b + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums, vx

    def scores(self, texts) -> np.ndarray:
        words, out = _Words(), []
        for at in range(0, len(texts), _ROWS):
            rows = [describe(t, words) for t in texts[at : at + _ROWS]]
            score = self.raw(*self.inputs(rows))[0].astype(np.float64)
            out.append(1 / (1 + np.exp(-np.clip(score, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(rows: list[tuple], labels: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss, Adam steps over mixed batches; rows as ``describe`` gives them."""
    stats = np.array([r[0] for r in rows], np.float32)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T.astype(np.float32)
    model = Model(stats.mean(axis=0), stats.std(axis=0) + 1e-3, edges, seed)
    order = np.random.default_rng(seed)
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in ("w", "v")}
    mb, vb, step = 0.0, 0.0, 0
    model.b = np.float32(np.log((labels.mean() + 0.01) / (1.01 - labels.mean())))
    for epoch in range(EPOCHS):
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
        mixed = order.permutation(len(rows))
        for at in range(0, len(rows), 256):
            part = mixed[at : at + 256]
            ids, x, starts = model.inputs([rows[i] for i in part])
            score, sums, vx = model.raw(ids, x, starts)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[part]).astype(np.float32) / len(part)
            of = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(ids))))
            e = error[of]
            size = len(model.w)
            grads = {"w": np.bincount(ids, e * x, size).astype(np.float32)}
            gv = (sums[of] - vx) * (x * e)[:, None]
            grads["v"] = np.stack([np.bincount(ids, gv[:, k], size) for k in range(RANK)], axis=1).astype(np.float32)
            step += 1
            for k, g in grads.items():
                p, (m, s) = getattr(model, k), moments[k]
                g += 1e-5 * p
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            gb = float(error.sum())
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            model.b -= np.float32(rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8))
    return model


def held_out(id_col) -> Column:
    """Whether a row is kept from learning: crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", limit=TRAIN_ROWS) -> Model | None:
    """Model fitted on at most ``limit`` labelled ids; None without any."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(marks, "_id")
    found = texts.select("_id", "_label", _described("_text").alias("d")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = found.select("_label", "d.stats", "d.ids", "d.weights").toArrow()
    if not rows.num_rows:
        return None

    def cells(name, dtype):
        return [np.array(c.values, dtype) for c in rows.column(name)]

    parts = zip(cells("stats", np.float32), cells("ids", np.int32), cells("weights", np.float32), strict=True)
    return fit(list(parts), rows.column("_label").to_numpy().astype(np.float32))


def score(model: Model | None, text: Column) -> Column:
    """Probability of good quality of each text."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    return scored(text)


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(score(model, docs[text_col]) >= threshold)
