"""Names inside texts by an index of their rarest pieces.

A name that stands in a text brings all its pieces of ``PIECE`` characters along. Each name is listed under the piece
that fewest names of its site have (short names under themselves); texts meet that list by an equi join on (site,
piece), so only names that share a piece with a text are ever compared with it, whatever the number of names. What the
join finds is then checked on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.functions.text import let
from citeframe.session import stage

PIECE = 4


def pieces(text: Column, size: Column) -> Column:
    """Distinct pieces of ``size`` characters of a text; none when it is shorter."""

    def cut(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= size, F.sequence(F.lit(1), F.size(chars) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, size), ""))

    return F.array_distinct(let(F.split(text, ""), cut))


def name_index(names: DataFrame) -> DataFrame:
    """(site_id, piece, ord, name, needle) of names (site_id, ord, name, needle), each under its rarest piece."""
    size = F.least(F.length("needle"), F.lit(PIECE))
    cut = names.where(F.length("needle") > 0).select("*", F.explode(pieces(F.col("needle"), size)).alias("piece"))
    shared = cut.groupBy("site_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("piece", F.struct("n", "piece")).alias("piece")
    return cut.join(shared, ["site_id", "piece"]).groupBy("site_id", "ord", "name", "needle").agg(rarest)


def with_names(texts: DataFrame, names: DataFrame, haystack: Column, out: str) -> DataFrame:
    """Adds ``out``: (ord, name) of the site's names whose ``needle`` the haystack contains, in order.

    Both are expected in the same normal form. Names without characters are in no text.
    """
    rows = stage(texts.select("*", haystack.alias("_haystack"), F.monotonically_increasing_id().alias("_row")), "phrase-texts")
    index = stage(name_index(names), "phrase-index")
    sizes = [r[0] for r in index.select(F.length("piece")).distinct().collect()]  # at most PIECE values
    if not sizes:
        return rows.drop("_haystack", "_row").withColumn(out, F.array().cast("array<struct<ord: int, name: string>>"))
    own = F.flatten(F.array(*(pieces(F.col("_haystack"), F.lit(n)) for n in sizes)))
    met = rows.select("site_id", "_row", F.explode(own).alias("piece")).join(index, ["site_id", "piece"])
    listed = met.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("ord", "name", "needle"))).alias("_names"))
    found = F.filter("_names", lambda x: F.contains(F.col("_haystack"), x["needle"]))
    kept = F.transform(found, lambda x: F.struct(x["ord"].cast("int").alias("ord"), x["name"].alias("name")))
    done = rows.join(listed, "_row", "left").withColumn(out, F.coalesce(kept, F.array().cast("array<struct<ord: int, name: string>>")))
    return done.drop("_haystack", "_row", "_names")
