"""Benchmark decontamination with a BM25 index of test items, searched by block-max WAND.

Test items are the indexed side: an impact is a BM25 term weight divided by the item's own full score, so 1 means
that a passage holds every term of the item. Passages of a document (windows of twice the longest item, half
overlapping, so every stretch of that length lies whole in one) are the queries. The most frequent terms, which give
no item more than half the threshold, are set aside: what an item still needs must come from its rarer terms, and
their sums per item rule out most passages, eight at a time and then singly. The rest go through WAND with block maxima, which returns every item at or above
the threshold. Each is verified against the passage: shared five-word shingles of the question (all but the last
sentence) and words of the answer (the last sentence).

Words are runs of letters, digits and underscores in lower case; letters of scripts written without spaces are words of
their own, so an item is found inside running text of such a script too. The items are dealt by hash into indexes of about
``INDEX_BYTES``, so what is broadcast is bounded for any number of items; documents are never shuffled. Weights and
the length of passages come from all items, so the hits do not depend on how the items are dealt.

Defined cases: null or wordless texts and items match nothing; several rows of one item or document are treated one
by one; an empty table gives no hits. An item of one sentence has its last third as answer. Extra columns are kept.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeframe.llm.languages import UNSPACED
from citeframe.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.5
SHINGLE = 5
QUESTION, ANSWER = 0.5, 0.5
INDEX_BYTES = 8_000_000
POSTINGS = 32
RUN = 8
K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")
_SIGN = re.compile(f"[{UNSPACED}]")
_MIXED = re.compile(f"[{UNSPACED}]|(?:(?![{UNSPACED}])\\w)+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
HIT = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (_MIXED if _SIGN.search(low) else _WORD).findall(low)


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item."""
    parts = [w for w in map(words, _SENTENCE.split(text.strip())) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    cut = len(parts[0]) - max(1, len(parts[0]) // 3)
    return parts[0][:cut] or parts[0], parts[0][cut:]


def shingles(tokens: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


@dataclass
class Item:
    item_id: int
    question: set
    n: int
    answer: Counter


@dataclass
class Figures:
    """What weights and passages depend on, over all items: how many, their words, the longest, and items by term."""

    n: int
    total: int
    longest: int
    df: dict[str, int]


class Index:
    """Postings of one block of items, in order of item, with the largest impact of each block of postings.

    ``figures`` are those of all items; without them the block is taken as all.
    """

    def __init__(self, rows: list[tuple[int, str]], figures: Figures | None = None):
        bags = [(i, t, w) for i, t in rows if (w := words(t))]
        own = Counter(term for *_, w in bags for term in set(w))
        if figures is None:
            figures = Figures(len(bags), sum(len(w) for *_, w in bags), max((len(w) for *_, w in bags), default=1), own)
        df, mean = figures.df, figures.total / max(figures.n, 1)
        self.items, postings = [], {}
        for k, (item_id, text, bag) in enumerate(bags):
            norm = K1 * (1 - B + B * len(bag) / mean)
            weight = {
                t: math.log(1 + (figures.n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                for t, tf in Counter(bag).items()
            }
            full = sum(weight.values())
            for t, x in weight.items():
                postings.setdefault(t, []).append((k, x / full))
            question, answer = question_answer(text)
            n = min(SHINGLE, len(question))
            self.items.append(Item(item_id, shingles(question, n), n, Counter(answer)))
        self.longest = figures.longest
        self.terms = {t: j for j, t in enumerate(sorted(postings, key=lambda t: (-own[t], t)))}
        self.docs, self.impacts, self.block_max = [], [], []
        for t in self.terms:
            docs, impacts = zip(*postings[t], strict=True)
            self.docs.append(list(docs))
            self.impacts.append(list(impacts))
            self.block_max.append([max(impacts[a : a + POSTINGS]) for a in range(0, len(docs), POSTINGS)])
        self.upper = np.array([max(b) for b in self.block_max] + [0.0])
        self._bounds(len(bags))

    def _bounds(self, n: int) -> None:
        """Arrays for bounds over many terms at once.

        The most frequent terms are set aside as long as they give no item more than half the threshold; what each
        item then still needs must come from its rarer terms.
        """
        self.starts = np.cumsum([0] + [len(d) for d in self.docs])
        self.flat_docs = np.array([d for docs in self.docs for d in docs], np.int64)
        self.flat_impacts = np.array([x for impacts in self.impacts for x in impacts])
        spare, self.frequent = np.zeros(n), 0
        for docs, impacts in zip(self.docs, self.impacts, strict=True):
            more = spare.copy()
            more[docs] += impacts
            if more.max() > THRESHOLD / 2:
                break
            spare, self.frequent = more, self.frequent + 1
        self.needs = THRESHOLD - spare - 1e-9

    def possible(self, ids: np.ndarray) -> bool:
        """Whether the rarer terms among ``ids`` leave any item a way to the threshold."""
        own = np.unique(ids[(ids >= self.frequent) & (ids < len(self.docs))])
        lengths = self.starts[own + 1] - self.starts[own]
        total = int(lengths.sum())
        if not total:
            return False
        at = np.repeat(self.starts[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(total)
        scores = np.bincount(self.flat_docs[at], self.flat_impacts[at], len(self.needs))
        return bool((scores >= self.needs).any())

    def passages(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Windows that could reach the threshold; runs of eight windows are ruled out as one first."""
        size, step, out = 2 * self.longest, self.longest, []
        last = max(len(ids) - step, 1)
        for run in range(0, last, RUN * step):
            if self.possible(ids[run : run + (RUN + 1) * step]):
                for start in range(run, min(run + RUN * step, last), step):
                    if self.possible(ids[start : start + size]):
                        out.append((start, min(start + size, len(ids))))
        return out

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose impacts over ``terms`` reach the threshold."""
        lists = [[0, t] for t in terms]
        if float(self.upper[terms].sum()) < THRESHOLD:
            return []
        hits = []
        while True:
            lists = [c for c in lists if c[0] < len(self.docs[c[1]])]
            lists.sort(key=lambda c: self.docs[c[1]][c[0]])
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(lists):
                bound += self.upper[t]
                if bound >= THRESHOLD - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return hits
            item = self.docs[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]] == item:
                pivot += 1
            block, leave = 0.0, None
            for c in lists[: pivot + 1]:
                docs = self.docs[c[1]]
                at = self._seek(docs, c[0], item)
                if at < len(docs):
                    b = at // POSTINGS
                    block += self.block_max[c[1]][b]
                    end = docs[min((b + 1) * POSTINGS, len(docs)) - 1] + 1
                    leave = end if leave is None else min(leave, end)
            if block >= THRESHOLD - 1e-9:
                score = 0.0
                for c in lists[: pivot + 1]:
                    c[0] = self._seek(self.docs[c[1]], c[0], item)
                    if c[0] < len(self.docs[c[1]]) and self.docs[c[1]][c[0]] == item:
                        score += self.impacts[c[1]][c[0]]
                        c[0] += 1
                if score >= THRESHOLD - 1e-9:
                    hits.append((item, score))
            else:
                # no item before the nearest block end, or before the next list begins, can reach the threshold
                if pivot + 1 < len(lists):
                    after = self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]]
                    leave = after if leave is None else min(leave, after)
                leave = max(leave or 0, item + 1)
                for c in lists[: pivot + 1]:
                    c[0] = self._seek(self.docs[c[1]], c[0], leave)

    @staticmethod
    def _seek(docs: list[int], at: int, item: int) -> int:
        """First place at or after ``at`` with an item not below ``item``."""
        step, low = 1, at
        while at < len(docs) and docs[at] < item:
            low, at, step = at, at + step, step * 2
        high = min(at, len(docs))
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if docs[mid] < item else (low, mid)
        return low

    def hits(self, text: str | None) -> list[dict]:
        """Verified items of a whole text, the best passage of each."""
        tokens = words(text)
        if not tokens or not self.terms:
            return []
        get, none = self.terms.get, len(self.terms)
        ids = np.array([get(w, none) for w in tokens], np.int64)
        best: dict[int, dict] = {}
        for start, end in self.passages(ids):
            terms = [t for t in np.unique(ids[start:end]).tolist() if t < none]
            found = self.search(terms)
            if not found:
                continue
            passage = tokens[start:end]
            grams: dict[int, set] = {}
            bag = Counter(passage)
            for k, score in found:
                item = self.items[k]
                own = grams.setdefault(item.n, shingles(passage, item.n))
                question = len(item.question & own) / len(item.question)
                answer = sum((item.answer & bag).values()) / sum(item.answer.values())
                if question >= QUESTION and answer >= ANSWER:
                    hit = {"item_id": item.item_id, "score": score, "question": question, "answer": answer}
                    old = best.get(k)
                    if old is None or (question, answer, score) > (old["question"], old["answer"], old["score"]):
                        best[k] = hit
        return [best[k] for k in sorted(best)]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _bag(texts: pa.Array) -> pa.Array:
    return pa.array([words(t.as_py()) for t in texts], pa.list_(pa.string()))


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = INDEX_BYTES):
    """Broadcast indexes, each over about ``size`` bytes of items, with weights and passages of all items."""
    spark = items.sparkSession
    rows = items.select(items[id_col].cast("long").alias("i"), items[text_col].alias("t")).where("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = total // size + 1
    if n == 1:
        yield spark.sparkContext.broadcast(Index(sorted(((r.i, r.t) for r in rows.collect()), key=repr)))
        return
    rows = rows.select("i", "t", _bag("t").alias("bag"), F.pmod(F.xxhash64("t"), F.lit(n)).alias("part")).where("size(bag) > 0")
    rows = stage(rows, "items")
    all_items = rows.agg(F.count(F.lit(1)), F.sum(F.size("bag")), F.max(F.size("bag"))).first()
    if not all_items[0]:
        yield spark.sparkContext.broadcast(Index([]))
    terms = rows.select("part", F.explode(F.array_distinct("bag")).alias("term")).groupBy("term", "part").agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    terms = stage(terms.select("term", "part").join(df, "term"), "item-terms")
    for part in range(n):
        own = rows.where(F.col("part") == part).select("i", "t").collect()
        if own:
            figures = Figures(*all_items, {r.term: r.df for r in terms.where(F.col("part") == part).collect()})
            yield spark.sparkContext.broadcast(Index(sorted(((r.i, r.t) for r in own), key=repr), figures))


def hits(text: Column, index) -> Column:
    """Verified items of ``text`` in a broadcast index."""

    @F.arrow_udf(HIT)
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
        return pa.array([index.value.hits(t) for t in texts.to_pylist()], kind)

    return found(text)


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", size: int = INDEX_BYTES) -> DataFrame:
    """(id, item_id, score, question, answer): one row for each document row and item found in it."""
    out = None
    for index in indexes(items, size=size):
        found = docs.select(docs[id_col].alias("doc_id"), F.explode(hits(docs[text_col], index)).alias("h")).select("doc_id", "h.*")
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col="text", size: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    for index in indexes(items, size=size):
        docs = docs.where(F.size(hits(docs[text_col], index)) == 0)
    return docs
