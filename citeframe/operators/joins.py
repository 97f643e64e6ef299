"""Join helper for keys that may hold a large share of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a key with this share of the rows, and this many of them, is joined apart
HOT_SHARE, HOT_ROWS = 1 / 32, 1000
_TRACKED = 2048


def hot_keys(big: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys that hold ``HOT_SHARE`` of the rows or more, by a frequent-items sketch.

    Sketches of all tasks merge; what they miss of a key's rows is under one in ``_TRACKED`` of all, so no such key is
    missed, and there are never more than ``1 / HOT_SHARE`` of them.
    """
    sketch = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {int(2 / HOT_SHARE)}, {_TRACKED})")
    rows, top = big.agg(F.count(F.lit(1)), sketch).first()
    least = max(HOT_ROWS, rows * HOT_SHARE)
    return [x["item"] for x in top or () if x["count"] >= least]


def lookup_join(big: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", measured: bool = False) -> DataFrame:
    """Join ``big`` with a ``lookup`` that is unique on ``keys``; inner, left, left_semi or left_anti.

    A hot key is many rows of ``big`` against one row of ``lookup``. For these join types Spark may split the left
    side of a large partition and read its right side once per piece (adaptive skew join), so the lookup is
    repeated for hot partitions only, as often as their size asks for, and is broadcast where it is small.

    That acts above a size of partitions. ``measured`` finds hot keys beforehand, at the price of one more pass over
    the keys: their rows stay where they are and meet the few rows of the lookup that have those keys, which are
    broadcast; all other rows are joined as before.
    """
    hot = hot_keys(big, keys) if measured else []
    if not hot:
        return big.join(lookup, keys, how)

    def is_hot(df: DataFrame):
        # both sides hash the same type
        return F.xxhash64(*(df[k].cast(big.schema[k].dataType) for k in keys)).isin(hot)

    few = F.broadcast(lookup.where(is_hot(lookup)))
    apart = big.where(is_hot(big)).join(few, keys, how)
    return apart.unionByName(big.where(~is_hot(big)).join(lookup.where(~is_hot(lookup)), keys, how))
