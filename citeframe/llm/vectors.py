"""Exact top-k inner products with vector-approximation files.

Components become integers floor(1024 x). An approximation keeps only their leading bits, one signed byte for each
component: cell c stands for the integers from c * 2^s to (c + 1) * 2^s - 1, with s so large that every cell fits.
The inner product of a query with any vector of a cell then lies between 2^s q.c plus (2^s - 1) times the sum of
the query's negative components and the same with its positive ones: the bounds are q.c plus two constants of the
query. The scan reads approximations only. It keeps for each query what can still be among the best ``keep`` (``k``
and all rows of the query's own id) by these bounds; exact vectors are then read in order of bound, first the ``keep``
with the best bound, then those
whose bound still reaches the worst exact score of these, after which the result is certain.

Equal vectors are one class of which only the ``k + 1`` smallest ids are kept (one may be the query's own), so that
a very common vector costs no more than a rare one. Queries are a stated set; they meet the approximations in
blocks of ``QUERY_BLOCK`` distinct vectors, one after the other: the driver holds one block at a time, each block's
bounds are written before the next one starts, and the plan does not grow with the queries.

Integers are cut at plus and minus 2^55. Where inner products may pass 2^62, they are decimals of 38 digits and scores
outside of a long are given as its ends; where bounds may pass 2^53, they are widened by what float64 can lose.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate.
Missing components of shorter vectors count as 0. Rows of one vec_id are one another's own rows, and as queries they
have one list, the best of all their vectors; a null id takes no part. Repeated rows count once. Scores tie by smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeframe.session import shared_dir, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1024
TOP = 10
QUERY_BLOCK = 4096
CELL_BITS = 7
LIMIT = float(1 << 55)
_LONG = (1 << 63) - 1


def product(a: str, b: str, wide: bool = False) -> Column:
    """Integer inner product; what is missing in the shorter vector counts as 0. ``wide`` ones are decimals."""
    if not wide:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    part, whole = "decimal(19,0)", "decimal(38,0)"
    terms = F.zip_with(a, b, lambda x, y: F.coalesce((x.cast(part) * y.cast(part)).cast(whole), F.lit(0).cast(whole)))
    return F.aggregate(terms, F.lit(0).cast(whole), lambda s, x: (s + x).cast(whole))


def integers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): usable vectors as integers, repeated rows once."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    usable = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        "vec_id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    )
    return usable.select("vec_id", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT)))).alias("v")).distinct()


def _scan(queries: np.ndarray, numbers: np.ndarray, keeps: list[int], shift: int):
    """Task over approximations: what may be among the best ``keeps`` classes of each query."""
    q = queries.astype(np.float64)
    width = float((1 << shift) - 1)
    gap = width * np.abs(q).sum(axis=1)
    below = width * np.minimum(q, 0).sum(axis=1)
    largest = np.abs(q).sum(axis=1) * float(1 << shift) * (2 << CELL_BITS)
    slack = np.where(largest < 2.0**52, 0.0, largest * (q.shape[1] + 8) * 2.0**-51)
    gap = gap + 2 * slack

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q]
        for batch in batches:
            ids, cells = batch.column("class").to_numpy(), batch.column("cells").to_pylist()
            lengths = np.array([len(c) for c in cells])
            for size in np.unique(lengths):
                pick = np.nonzero(lengths == size)[0]
                width_q = min(int(size), q.shape[1])
                c = np.frombuffer(b"".join(cells[i] for i in pick), np.int8).reshape(len(pick), size)
                for at in range(0, len(pick), 8192):
                    part = c[at : at + 8192, :width_q].astype(np.float64)
                    dots = (q[:, :width_q] @ part.T) * float(1 << shift)
                    own = ids[pick[at : at + 8192]]
                    for k in range(len(q)):
                        (old_ids, old), keep = found[k], keeps[k]
                        floor = np.partition(old, -keep)[-keep] - gap[k] if len(old) >= keep else -np.inf
                        new = np.nonzero(dots[k] >= floor)[0]
                        if len(new):
                            all_ids, all_dots = np.append(old_ids, own[new]), np.append(old, dots[k][new])
                            if len(all_dots) > keep:
                                least = np.partition(all_dots, -keep)[-keep] - gap[k]
                                all_ids, all_dots = all_ids[all_dots >= least], all_dots[all_dots >= least]
                            found[k] = (all_ids, all_dots)
        for k, (ids, dots) in enumerate(found):
            if len(ids):
                low = dots + below[k] - slack[k]
                columns = [np.full(len(ids), numbers[k]), ids, low, low + gap[k]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query", "class", "low", "high"])

    return run


def top(table: DataFrame, is_query: Column, k: int = TOP, id_col="vec_id", vector_col="embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (over vec_id) holds, against all rows."""
    spark = table.sparkSession
    rows = stage(integers(table, id_col, vector_col), "vector-rows")
    first = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.select("*", F.row_number().over(first).alias("r")).where(F.col("r") <= k + 1)
    classes = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    most, longest = classes.agg(F.max(F.array_max(F.transform("v", lambda c: F.greatest(c, -c - 1)))), F.max(F.size("v"))).first()
    wide = (longest or 0) * (int(most or 0) + 1) ** 2 >= 1 << 62
    shift = max(0, int(most or 0).bit_length() - CELL_BITS)
    cell = F.transform("v", lambda c: F.lpad(F.hex(F.shiftright(c, shift).bitwiseAND(F.lit(255))), 2, "0"))
    cells = stage(classes.select("class", F.unhex(F.array_join(cell, "")).alias("cells")), "vector-cells")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    # a query's list has room for all rows of its own id
    own_rows = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    keeps = queries.join(own_rows, "query_id").groupBy("v").agg((F.max("n") + k).cast("int").alias("keep"))
    wanted = stage(keeps.withColumn("query", F.monotonically_increasing_id()), "vector-queries")
    n, most_kept = wanted.agg(F.count(F.lit(1)), F.max("keep")).first()
    parts = n // block + 1
    folder = os.path.join(shared_dir(spark), "citeframe-stages", f"vector-scans-{uuid.uuid4().hex}")
    kinds = "query long, class long, low double, high double"
    for part in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).collect()
        size = max((len(r.v) for r in own), default=0)
        matrix = np.array([r.v + [0] * (size - len(r.v)) for r in own], np.int64).reshape(len(own), size)
        scan = _scan(matrix, np.array([r.query for r in own], np.int64), [r.keep for r in own], shift)
        cells.mapInArrow(scan, kinds).write.mode("append").parquet(folder)
    bounds = spark.read.schema(kinds).parquet(folder)
    bounds = stage(bounds.join(wanted.select("query", "keep"), "query"), "vector-bounds")
    by_low = Window.partitionBy("query").orderBy(F.desc("low"), "class")
    # the literal lets map tasks trim their rows first
    floor = bounds.select("query", "keep", "low", F.row_number().over(by_low).alias("r")).where((F.col("r") <= most_kept) & (F.col("r") <= F.col("keep")))
    floor = floor.groupBy("query").agg(F.when(F.count("*") == F.max("keep"), F.min("low")).alias("floor"))
    open_ = bounds.join(floor, "query").where("floor is null or high >= floor")
    order = Window.partitionBy("query").orderBy(F.desc("high"), "class")
    ordered = stage(open_.select("query", "keep", "class", "high", F.row_number().over(order).alias("r")), "vector-open")

    def exact(these: DataFrame) -> DataFrame:
        read = these.join(classes.select("class", F.col("v").alias("cv"), "ids"), "class").join(wanted.drop("keep"), "query")
        return read.select("query", "keep", "class", "ids", product("v", "cv", wide).alias("score"))

    near = stage(exact(ordered.where(F.col("r") <= F.col("keep"))), "vector-near")
    worst = near.groupBy("query").agg(F.min("score").alias("worst"))
    least = F.col("worst").cast("double")
    far = ordered.where(F.col("r") > F.col("keep")).join(worst, "query").where(F.col("high") >= least - F.abs(least) * 1e-15)
    scored = near.union(exact(far)).select("query", "keep", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = scored.select("*", F.row_number().over(best).alias("r")).where((F.col("r") <= most_kept) & (F.col("r") <= F.col("keep")))
    answers = queries.join(wanted, "v").join(lists, "query").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    score = F.col("score").cast("decimal(38,0)")
    score = F.greatest(F.least(score, F.lit(_LONG).cast("decimal(38,0)")), F.lit(-_LONG - 1).cast("decimal(38,0)")).cast("long") if wide else F.col("score")
    return answers.select("query_id", F.row_number().over(final).alias("rank"), "vec_id", score.alias("score")).where(F.col("rank") <= k)
