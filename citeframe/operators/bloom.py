"""Bloom filters of stored keys: rows that surely have no partner are left out before they are shuffled.

A filter has no false negatives, so a join or anti join behind it stays exact. It is built by an aggregate that
combines before its shuffle, and never has more than ``MAX_BITS`` bits: with many more keys it only prunes less.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BITS = 1 << 26
MIN_BITS = 1 << 16
BITS_PER_KEY = 12
PROBES = 4


def _bits(keys: int) -> int:
    return min(max(MIN_BITS, 1 << (BITS_PER_KEY * max(keys, 1) - 1).bit_length()), MAX_BITS)


def hashed(columns: list) -> Column:
    return F.xxhash64(*columns)


def _places(hashes: np.ndarray, bits: int):
    """The bits of each 64-bit hash, one array for each probe: double hashing with an odd step."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (h + np.uint64(k) * step) & np.uint64(bits - 1)


class Bloom:
    """Bits of a filter, on the driver and in the tasks that probe it."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which 64-bit hashes may be stored."""
        found = np.ones(len(hashes), bool)
        for at in _places(hashes, len(self.words) * 64):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def may_hold(self, *columns) -> Column:
        """Column: whether the key may be stored; a null key is hashed like any other."""
        bloom = self

        @F.arrow_udf(BooleanType())
        def probe(hashes: pa.Array) -> pa.Array:
            return pa.array(bloom.holds(np.ascontiguousarray(hashes.to_numpy(zero_copy_only=False).astype(np.int64))))

        return probe(hashed(list(columns)))


def bloom_of(keys: DataFrame, columns: list[str], expected: int | None = None) -> Bloom:
    """Filter of the keys in ``columns``; ``expected`` is their number, counted when not given."""
    bits = _bits(keys.count() if expected is None else expected)
    hashes = keys.select(hashed(columns).alias("h"))
    found = hashes.mapInArrow(lambda batches: _set_bits(batches, bits), "word long, mask long")
    found = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Bloom(words)


def _set_bits(batches, bits: int):
    """The words of the filter that a task's keys touch."""
    words = np.zeros(bits // 64, np.uint64)
    for batch in batches:
        for at in _places(batch.column("h").to_numpy(), bits):
            np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    touched = np.nonzero(words)[0]
    yield pa.RecordBatch.from_arrays([pa.array(touched), pa.array(words[touched].view(np.int64))], names=["word", "mask"])
