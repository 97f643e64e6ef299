"""Connected components by alternating large and small stars.

Every round links the larger neighbours of a node to its smallest one (large star), then the smaller neighbours
(small star). Labels shrink to the smallest node of a component in about log n rounds. A node with very many
neighbours is one key of a join with a unique side, which Spark can split, and of aggregates that combine before
the shuffle; its neighbours are never gathered. Rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.session import stage


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): each node of the edges (u, v) with the smallest node of its component."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "components")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(inner.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
