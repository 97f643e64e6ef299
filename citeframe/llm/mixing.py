"""Mixing sources to target weights.

Sources in order of code point (null last) weigh 3, 1, 2, again and again. They share 150 % of all words by weight;
no target goes beyond twice its source's words, and what is left over is shared again by weight among the others.
That is filling to a common level: sources sorted by words per weight are capped from the smallest on, until the
level that the rest would get no longer reaches the cap.

Documents of a source are put in the random order of md5(id). Distributed prefix sums of their words give each its
place. The source's budget (its target, rounded) is cut exactly: whole passes over the source first, then the
part of the order up to what remains; the document on the cut is taken in part.

Defined cases: null and wordless texts have size 0, take no words and are carried along where their place is taken.
Null sources are one source, the last. A null id has the key of the word null. Rows with equal ids are ordered by
size and then are alike. An empty table gives an empty mix. Extra columns are kept in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeframe.llm.prefix import digits_for, running
from citeframe.llm.rows import spread, whole
from citeframe.session import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """Target of each source; sizes: source_key, source_size, one row for each source."""
    order, all_rows = Window.orderBy("source_key"), Window.partitionBy(F.lit(1))
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    ranked = sizes.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * MOST)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(fill), F.lit(0.0)).alias("cap_before"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))).alias("weight_left"),
        (F.sum("source_size").over(all_rows).cast("double") * SHARE).alias("words"),
    )
    rest = before.withColumn("rest", F.col("words") - F.col("cap_before")).withColumn(
        "open", F.col("weight") * F.col("rest") / F.col("weight_left") < F.col("cap")
    )
    first_open = F.min(F.when(F.col("open"), F.struct(-F.col("weight_left"), "rest"))).over(all_rows)
    level = rest.withColumn("level", first_open)
    share = F.col("weight") * F.col("level")["rest"] / -F.col("level")["col1"]
    return level.select("source_key", "source_size", F.when(F.col("open"), share).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", payload: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target, taken (words) and copies (times the row is in the mix)."""
    rows = docs.select(
        whole(docs, payload),
        docs[id_col].alias("id"),
        F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("t")).alias("source_key"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("null")).cast("binary")).alias("key"),
    )
    # all of it follows from the row alone, so only the narrow columns are written for the sums
    narrow = stage(rows.select("source_key", "size", "key"), "mix-sizes")
    sources = stage(
        narrow.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources"
    )
    most = sources.agg(F.max("n")).first()[0] or 0
    budgets = targets(sources.select("source_key", "source_size")).select("*", F.floor(F.col("target") + 0.5).alias("budget"))
    placed = running(rows, "source_key", "key", "size", digits_for(most), ["size"], counted=narrow)
    cut = placed.join(budgets, "source_key").select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).alias("passes"),
    )
    left = F.col("budget") - F.col("passes") * F.col("source_size") - F.col("start")
    part = F.greatest(F.lit(0), F.least(left, F.col("size")))
    return cut.select(
        "row", "id", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("passes") + F.when(left > 0, 1).otherwise(0)).cast("int").alias("copies"),
    )


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it."""
    rows = mix(docs, id_col, text_col, source_col).where("copies > 0")
    return spread(rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_pass")), []).select(*docs.columns)
