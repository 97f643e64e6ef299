"""Languages of words and texts by a linear-chain conditional random field.

Every word has features: itself, its prefixes and suffixes, its character n-grams (hashed), and what a lexicon says
of it, that is how the word's uses share out among the languages. Feature weights and transitions between languages
are learned together by the gradient of the likelihood; forward and backward sums then give each word of a text the
probability of each language, so a text that changes its language does so at the right words. A text's language is
the one with the highest mean probability over its words, and that mean is the score.

The field is fitted on the driver from a bounded sample: at most ``TRAIN_ROWS`` texts of each language, the least by
a hash of id and text among those whose crc32(id as text) mod 4 is not 2, and of each the ``TRAIN_RUNS`` runs of
``RUN_WORDS`` words with the least hashes. One half of the runs makes the lexicon. Training sequences chain runs of
the other half, of one language or of several, which is where transitions are learned. Language, source and id are
no inputs of a prediction. Every text is labelled whole, in place, without a shuffle: its words are cut into chunks
whose transfer matrices join exactly, and chunks are worked on in blocks, so memory does not grow with a text's
length times anything.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text when no row has a
language. Letters of scripts written without spaces are words of their own. Ties go to the first language in
code-point order. Repeated rows are labelled alike; a null id is never held out. An empty table gives an empty
result. Extra columns are no concern, as the operator is a column expression.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS, TRAIN_RUNS, RUN_WORDS = 1500, 12, 16
BUCKETS, BINS = 1 << 16, 6
AFFIX, GRAMS = 4, (2, 3, 4)
STEPS, SEQUENCES, CHAINED, STAY = 300, 64, 3, 0.5
CHUNK, CHUNKS = 256, 1024
UNKNOWN = "und"
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(f"[{UNSPACED}]|(?:(?![{UNSPACED}])[^\\W\\d_])+")
_KNOWN, _BATCH, _LONG_TEXT = 200_000, 1 << 16, 1 << 20


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(8)) % np.uint64(BUCKETS)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words in lower case and the words they belong to: itself, affixes, n-grams with its ends."""
    flat = np.array(list("".join([f"^{w}$" for w in words]))).view(np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts, place = ends - sizes, np.arange(len(flat))
    last = np.repeat(ends, sizes)
    own = np.repeat(np.arange(len(words)), sizes)
    ids = [np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words)) % np.uint64(BUCKETS)]
    of = [np.arange(len(words))]
    gram = flat
    for k in range(1, max(AFFIX, *GRAMS) + 1):
        if k > 1:
            gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[k - 1 :]
        tagged = gram + np.uint64(k << 56)
        if k in GRAMS:
            inside = place[: len(gram)] + k <= last[: len(gram)]
            ids.append(_hash(tagged[inside]))
            of.append(own[: len(gram)][inside])
        if k <= AFFIX:
            long = np.nonzero(sizes - 2 >= k)[0]
            ids += [_hash(tagged[starts[long] + 1] + np.uint64(1 << 60)), _hash(tagged[ends[long] - 1 - k] + np.uint64(2 << 60))]
            of += [long, long]
    return np.concatenate(ids).astype(np.int64), np.concatenate(of)


class Field:
    """A fitted field: languages, lexicon (bin of each language's share for a word), weights and transitions."""

    def __init__(self, languages: list[str], lexicon: dict[str, bytes]):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((BUCKETS + n * BINS + 1, n), np.float32)
        self.moves, self.first = np.zeros((n, n)), np.zeros(n)

    def inputs(self, words: list[str]):
        """Feature numbers of several words, one after the other, and where each begins."""
        words = [w.lower() for w in words]
        ids, of = features(words)
        n = len(self.languages)
        said = [self.lexicon.get(w) for w in words]
        met = [k for k, bins in enumerate(said) if bins is not None]
        unmet = [k for k, bins in enumerate(said) if bins is None]
        bins = np.frombuffer(b"".join([said[k] for k in met]), np.uint8).reshape(-1, n) + np.arange(n) * BINS + BUCKETS
        ids = np.concatenate([ids, bins.ravel(), np.full(len(unmet), BUCKETS + n * BINS)])
        of = np.concatenate([of, np.repeat(met, n).astype(np.int64), np.array(unmet, np.int64)])
        order = np.argsort(of, kind="stable")
        return ids[order], np.searchsorted(of[order], np.arange(len(words)))

    def scores(self, ids, starts) -> np.ndarray:
        """Log weights of all languages for each word, scaled by the root of its number of features."""
        sizes = np.diff(np.append(starts, len(ids)))
        return np.add.reduceat(self.weights[ids], starts, axis=0) / np.sqrt(sizes)[:, None]


def _norm(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def emissions(scores: np.ndarray) -> np.ndarray:
    """Factors of the languages for a word; the best one is 1."""
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), -60.0)).astype(np.float64)


class Chain:
    """Forward and backward sums over words laid end to end; ``first`` marks words that begin a text."""

    def __init__(self, field: Field):
        self.moves = np.exp(field.moves - field.moves.max())
        self.start = _norm(np.exp(field.first - field.first.max()), 0)

    def transfers(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each chunk the matrix from the languages before it to those at its end; e is (chunk, word, language)."""
        n = e.shape[-1]
        out = np.broadcast_to(np.eye(n), (len(e), n, n)).copy()
        for s in range(e.shape[1]):
            moved = (out.reshape(-1, n) @ self.moves).reshape(out.shape)
            moved = np.where(first[:, s, None, None], out.sum(axis=2, keepdims=True) * self.start, moved) * e[:, s, None, :]
            out = _norm(moved, (1, 2))
        return out

    def ends(self, transfers: np.ndarray):
        """Forward sums before and backward sums after each chunk."""
        n = transfers.shape[-1]
        before, after = np.empty((len(transfers), n)), np.empty((len(transfers), n))
        a, b = np.full(n, 1 / n), np.full(n, 1 / n)
        for c in range(len(transfers)):
            before[c], a = a, _norm(a @ transfers[c], 0)
        for c in range(len(transfers) - 1, -1, -1):
            after[c], b = b, _norm(transfers[c] @ b, 0)
        return before, after

    def sums(self, e, first, before, after):
        """Forward and backward sums at every word of the chunks."""
        alpha, beta = np.empty(e.shape), np.empty(e.shape)
        a, b = before, after
        for s in range(e.shape[1]):
            a = _norm(np.where(first[:, s, None], self.start, a @ self.moves) * e[:, s], 1)
            alpha[:, s] = a
        for s in range(e.shape[1] - 1, -1, -1):
            beta[:, s] = b
            moved = (e[:, s] * b) @ self.moves.T
            b = _norm(np.where(first[:, s, None], 1.0, moved), 1)
        return alpha, beta

    def blocks(self, table: np.ndarray, ids: np.ndarray, first: np.ndarray, chunk: int = CHUNK):
        """(from, to, forward, backward) for blocks of words; ``table`` has the factors of each word number.

        The last chunk is filled up with words that begin texts, so that they say nothing about those before.
        """
        count = -(-len(ids) // chunk)

        def block(c):
            at, to = c * chunk, min((c + CHUNKS) * chunk, len(ids))
            size = -(-(to - at) // chunk) * chunk
            e, f = np.ones((size, table.shape[1])), np.ones(size, bool)
            e[: to - at], f[: to - at] = table[ids[at:to]], first[at:to]
            return at, to, e.reshape(-1, chunk, table.shape[1]), f.reshape(-1, chunk)

        parts = range(0, count, CHUNKS)
        held = block(0)
        moved = np.concatenate([self.transfers(*(held if len(parts) == 1 else block(c))[2:]) for c in parts])
        before, after = self.ends(moved)
        for c in parts:
            at, to, e, f = held if len(parts) == 1 else block(c)
            alpha, beta = self.sums(e, f, before[c : c + CHUNKS], after[c : c + CHUNKS])
            yield at, to, alpha.reshape(-1, table.shape[1])[: to - at], beta.reshape(-1, table.shape[1])[: to - at]

    def marginals(self, table, ids, first, chunk: int = CHUNK):
        """(from, probabilities) for blocks of words."""
        for at, _, alpha, beta in self.blocks(table, ids, first, chunk):
            yield at, _norm(alpha * beta, 1)


def make_lexicon(runs: list[tuple[str, list[str]]], languages: list[str]) -> dict[str, bytes]:
    """Bin of each language's share in the uses of a word, uses weighed by the language's size."""
    used: dict[str, Counter] = defaultdict(Counter)
    size: Counter = Counter()
    for lang, words in runs:
        size[lang] += len(words)
        for w in words:
            used[w.lower()][lang] += 1
    out = {}
    for word, by in used.items():
        share = np.array([by[x] / max(size[x], 1) for x in languages])
        out[word] = bytes(np.minimum((share / share.sum() * BINS).astype(int), BINS - 1).tolist())
    return out


def fit(runs: list[tuple[str, list[str]]], seed: int = 11) -> Field | None:
    """Field of runs (language, words); None without any. Every second run of a language goes into the lexicon."""
    by: dict[str, list[list[str]]] = defaultdict(list)
    for lang, words in runs:
        by[lang].append(words)
    languages = sorted(by)
    if not languages:
        return None
    halves = {x: (by[x][::2], by[x][1::2] or by[x]) for x in languages}
    field = Field(languages, make_lexicon([(x, w) for x in languages for w in halves[x][0]], languages))
    n, rnd = len(languages), np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    coded = [[np.array([numbers.setdefault(w, len(numbers)) for w in words]) for words in halves[x][1]] for x in languages]
    ids, starts = field.inputs(list(numbers))
    sizes = np.diff(np.append(starts, len(ids)))
    squares, moved = np.full(field.weights.shape, 1e-6, np.float32), [np.full((n, n), 1e-6), np.full(n, 1e-6)]
    for step in range(STEPS):
        rate = 0.5 * (1 - step / STEPS) + 0.01
        words, labels, first = [], [], []
        for _ in range(SEQUENCES):
            lang = int(rnd.integers(n))
            for k in range(CHAINED):
                if k and rnd.random() > STAY:
                    lang = int(rnd.integers(n))
                run = coded[lang][int(rnd.integers(len(coded[lang])))]
                words.append(run)
                labels.append(np.full(len(run), lang))
                first.append(np.arange(len(run)) + k == 0)
        words, labels, first = np.concatenate(words), np.concatenate(labels), np.concatenate(first)
        kinds, which = np.unique(words, return_inverse=True)
        chosen = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in kinds])
        own, begins = ids[chosen], np.cumsum(sizes[kinds]) - sizes[kinds]
        table = emissions(field.scores(own, begins))
        chain = Chain(field)
        error, pairs = np.zeros((len(words), n)), np.zeros((n, n))
        error[np.arange(len(words)), labels] = 1
        for at, to, alpha, beta in chain.blocks(table, which, first, 48):
            error[at:to] -= _norm(alpha * beta, 1)
            inner = np.nonzero(~first[at:to])[0]
            inner = inner[inner > 0]
            xi = alpha[inner - 1][:, :, None] * chain.moves * (table[which[at:to][inner]] * beta[inner])[:, None, :]
            pairs -= _norm(xi, (1, 2)).sum(axis=0)
            np.add.at(pairs, (labels[at:to][inner - 1], labels[at:to][inner]), 1)
        by_word = np.stack([np.bincount(which, error[:, k], len(kinds)) for k in range(n)], axis=1)
        spread = np.repeat(by_word / np.sqrt(sizes[kinds])[:, None], sizes[kinds], axis=0)
        rows, back = np.unique(own, return_inverse=True)
        grad = np.stack([np.bincount(back, spread[:, k], len(rows)) for k in range(n)], axis=1) - 1e-3 * field.weights[rows]
        squares[rows] += grad**2
        field.weights[rows] += (rate * grad / np.sqrt(squares[rows])).astype(np.float32)
        for p, g, s in ((field.moves, pairs, moved[0]), (field.first, error[first].sum(axis=0), moved[1])):
            g = g / len(words)
            s += g**2
            p += 0.2 * rate * g / np.sqrt(s)
    return field


def held_out(id_col) -> Column:
    """Whether a row is kept from learning: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _runs(batches):
    """Runs of words of whole texts, the ones with the least hashes: (lang, hash, words)."""
    for batch in batches:
        rows = []
        for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
            words = WORD.findall(text or "")
            starts = range(0, len(words), RUN_WORDS)
            picked = sorted((zlib.crc32(f"{h}:{at}".encode()), at) for at in starts)[:TRAIN_RUNS]
            rows += [(lang, key, " ".join(words[at : at + RUN_WORDS])) for key, at in picked]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "key", "words"])


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", limit=TRAIN_ROWS) -> Field | None:
    """Field fitted on at most ``limit`` texts of each language; None if no row has one."""
    h = F.xxhash64(docs[id_col], docs[text_col]).alias("h")
    rows = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~held_out(id_col))
    narrow = rows.select(docs[lang_col].alias("lang"), h)
    ranked = narrow.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= limit)
    # one hash for each language, so that other texts are left out where they are read
    last = ranked.groupBy("lang").agg(F.max("h").alias("last")).collect()
    if not last:
        return None
    cut = F.create_map(*(F.lit(x) for r in last for x in (r["lang"], r["last"])))
    texts = rows.select(docs[lang_col].alias("lang"), h, docs[text_col].alias("text")).where(F.col("h") <= cut[F.col("lang")])
    texts = texts.dropDuplicates(["lang", "h"]).select("lang", "h", "text")
    found = texts.mapInArrow(_runs, "lang string, key long, words string").toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["key"], r["words"]))
    return fit([(r["lang"], r["words"].split(" ")) for r in found])


class Known(dict):
    """Word as it is written to the number of its factors; -1 for words without a letter."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.table = field, np.zeros((0, len(field.languages)))

    def numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self]
        for at in range(0, len(new), _BATCH):
            some = [w for w in new[at : at + _BATCH] if any(map(str.isalpha, w))]
            self.update((w, -1) for w in new[at : at + _BATCH])
            if some:
                self.update(zip(some, range(len(self.table), len(self.table) + len(some)), strict=True))
                self.table = np.concatenate([self.table, emissions(self.field.scores(*self.field.inputs(some)))])
        return np.array([self[w] for w in words], np.int64)

    def forget(self):
        if len(self) > _KNOWN:
            self.clear()
            self.table = self.table[:0]


def _words(text: str, spans: bool):
    """Words of a text and, if asked for, their places, in lists of bounded length."""
    if len(text) <= _LONG_TEXT and not spans:
        yield WORD.findall(text), []
        return
    each = WORD.finditer(text)
    while some := list(islice(each, _BATCH)):
        yield [m.group() for m in some], [m.span() for m in some] if spans else []


def _groups(texts: list):
    """Neighbouring texts, together of bounded length unless a single one is longer."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= _LONG_TEXT:
            yield group
            group, size = [], 0
    if group:
        yield group


def predict(field: Field, texts: list, spans: bool = False, known: Known | None = None):
    """(language, score, spans) of each text; spans are (start, end, language) of runs of words, if asked for.

    ``known`` remembers words from one call to the next, within bounds.
    """
    known = Known(field) if known is None else known
    chain, out, n = Chain(field), [], len(field.languages)
    for group in _groups(texts):
        known.forget()
        numbers, of, places, block, owners = [], [], [], [], []

        def look_up():
            own = known.numbers(block)
            good = own >= 0
            numbers.append(own[good])
            of.append(np.repeat([r for r, _ in owners], [k for _, k in owners])[good])
            if spans:
                begin = len(places) - len(good)
                places[begin:] = [x for x, g in zip(places[begin:], good.tolist(), strict=True) if g]
            block.clear()
            owners.clear()

        for row, text in enumerate(group):
            for words, where in _words(text, spans):
                block += words
                places += where
                owners.append((row, len(words)))
                if len(block) >= _BATCH:
                    look_up()
        if block:
            look_up()
        if numbers:
            ids, of = np.concatenate(numbers), np.concatenate(of)
        else:
            ids = of = np.zeros(0, np.int64)
        sizes = np.bincount(of, minlength=len(group))
        ends = np.cumsum(sizes)
        first = np.zeros(len(ids) + 1, bool)
        first[ends - sizes] = True
        mean, best = np.zeros((len(sizes), n)), []
        if len(ids):
            for begin, p in chain.marginals(known.table, ids, first[:-1]):
                rows = of[begin : begin + len(p)]
                mean += np.stack([np.bincount(rows, p[:, k], len(sizes)) for k in range(n)], axis=1)
                best += p.argmax(axis=1).tolist() if spans else []
        mean /= np.maximum(sizes, 1)[:, None]
        for k, (size, m) in enumerate(zip(sizes.tolist(), mean, strict=True)):
            if not size:
                out.append((UNKNOWN, 0.0, []))
                continue
            found = []
            for i in range(int(ends[k]) - size, int(ends[k])) if spans else ():
                if found and found[-1][2] == best[i]:
                    found[-1][1] = places[i][1]
                else:
                    found.append([*places[i], best[i]])
            top = int(m.argmax())
            out.append((field.languages[top], min(float(m[top]), 1.0), [(s, e, field.languages[x]) for s, e, x in found]))
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])


def language(field: Field | None, text: Column, spans: bool = False) -> Column:
    """Struct of the language of each text, its score, and with ``spans`` the runs of words by language."""
    if field is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.array().cast(T.ArrayType(SPAN)).alias("spans"))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])

    held: list[Known] = []

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Known(field))
        rows = predict(field, texts.to_pylist(), spans, held[0])
        return pa.array([{"lang": x, "score": s, "spans": [{"start": a, "end": b, "lang": y} for a, b, y in r]} for x, s, r in rows], kind)

    return found(text)
