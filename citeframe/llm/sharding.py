"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows of each input partition are put in random order. How many of a partition's rows go to each shard is drawn
from the exact law of a uniform permutation: a multivariate hypergeometric matrix with the partition sizes as row
sums and the shard sizes as column sums. It is drawn down a tree of partitions, 32 children at a time; each draw
inverts the cumulative weights around the mode (12 standard deviations, beyond which a double sees nothing), so its
work grows with the deviation, not with the rows. The first rows of a partition then go to shard 0, the next to
shard 1 and so on; each shard is put in random order again, and distributed prefix sums number its slots.

Law ``rows``: shard sizes differ by at most one, the first shards hold one more.

The rows with their places are written once, so what is counted is what is dealt, also when a task runs again.
Random numbers are hashes of the seed and of places, without Python on the executors.

Defined cases: a null text has size 1 and the checksum of the empty text. Null ids and repeated rows are rows like
any other. With fewer rows than shards the last shards stay empty. Extra columns are kept in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.llm.prefix import digits_for, running
from citeframe.llm.rows import spread, whole
from citeframe.session import stage

SHARDS = 8
SEED = 20
FAN = 32


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uniform(*parts) -> Column:
    """Number in [0, 1) from a hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows out of ``total`` are among the ``good`` ones, from a uniform number ``u``."""

    def pick(p: Column) -> Column:
        t, g, n = p["t"].cast("double"), p["g"].cast("double"), p["n"].cast("double")
        mean = F.when(t > 0, n * g / t).otherwise(0.0)
        deviation = F.sqrt(F.greatest(mean * (1 - g / F.greatest(t, F.lit(1.0))) * (t - n) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0)))
        low = F.greatest(F.lit(0).cast("long"), p["n"] + p["g"] - p["t"], F.floor(mean - 12 * deviation - 10))
        high = F.greatest(low, F.least(p["n"], p["g"], F.ceil(mean + 12 * deviation + 10)))
        return let(F.struct(low.alias("low"), high.alias("high"), t.alias("t"), g.alias("g"), n.alias("n"), p["u"].alias("u")), invert)

    def ratio(p: Column, x: Column) -> Column:
        """Weight of x + 1 over weight of x."""
        return (p["g"] - x) * (p["n"] - x) / ((x + 1) * (p["t"] - p["g"] - p["n"] + x + 1))

    def invert(p: Column) -> Column:
        span = F.sequence(p["low"], p["high"])
        one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        weight = F.aggregate(
            span, one, lambda a, x: F.struct((a["w"] * F.coalesce(ratio(p, x), F.lit(0.0))).alias("w"), (a["sum"] + a["w"]).alias("sum")),
            lambda a: a["sum"],
        )

        def walk(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), p["low"].alias("at"))
            return F.aggregate(
                span, start,
                lambda a, x: F.struct(
                    (a["w"] * F.coalesce(ratio(p, x), F.lit(0.0))).alias("w"), (a["sum"] + a["w"]).alias("sum"),
                    F.when(a["sum"] + a["w"] <= goal, x + 1).otherwise(a["at"]).alias("at"),
                ),
                lambda a: F.least(a["at"], p["high"]),
            )

        return let(p["u"] * weight, walk)

    return let(F.struct(total.alias("t"), good.alias("g"), draws.alias("n"), u.alias("u")), pick)


def split(left: Column, draws: Column, shards: int, *seed) -> Column:
    """How many of ``draws`` rows go to each shard when ``left`` rows of each are still to be given out."""
    start = F.struct(
        draws.alias("draws"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.array().cast("array<long>").alias("out"),
    )

    def step(a: Column, k: Column) -> Column:
        good = F.get(left, k)

        def add(x: Column) -> Column:
            return F.struct((a["draws"] - x).alias("draws"), (a["total"] - good).alias("total"), F.array_append(a["out"], x).alias("out"))

        return let(hypergeometric(a["total"], good, a["draws"], uniform(*seed, k)), add)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step, lambda a: a["out"])


def _children(shards: int, seed: int, depth: int):
    """Step of an aggregate over the children of a node: draws one child's rows from what is left."""

    def step(a: Column, child: Column) -> Column:
        def add(x: Column) -> Column:
            return F.struct(
                F.zip_with(a["left"], x, lambda p, q: p - q).alias("left"),
                F.array_append(a["out"], F.struct(child["part"].alias("part"), x.alias("gives"))).alias("out"),
            )

        return let(split(a["left"], child["n"], shards, F.lit(seed), F.lit(depth), child["part"]), add)

    return step


def matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, gives): how many rows of each partition go to each shard; counts: part, n."""
    levels = [stage(counts, "shard-counts")]
    total, most = levels[0].agg(F.sum("n"), F.max("part")).first()
    if total is None:
        return levels[0].select("part", F.array().cast("array<long>").alias("gives"))
    while most > 0:
        below = levels[-1].withColumn("up", F.floor(F.col("part") / FAN))
        levels.append(below.groupBy(F.col("up").alias("part")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "n"))).alias("children")))
        most //= FAN
    sizes = F.array(*(F.lit((total + shards - 1 - k) // shards).cast("long") for k in range(shards)))
    node = levels[-1].select("part", sizes.alias("gives"))
    for depth in range(len(levels) - 1, 0, -1):
        start = F.struct(F.col("gives").alias("left"), F.array().cast("array<struct<part: bigint, gives: array<bigint>>>").alias("out"))

        grown = node.join(levels[depth].select("part", "children"), "part")
        node = grown.select(F.inline(F.aggregate("children", start, _children(shards, seed, depth), lambda a: a["out"])))
        node = stage(node, "shard-matrix")
    return node


def shuffle(docs: DataFrame, id_col="doc_id", text_col="text", shards=SHARDS, seed=SEED, payload: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (struct ``row``) with id, size, text_crc32, shard and slot."""
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(
        whole(docs, payload), docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(seed), docs[id_col], text).alias("key"),
    )
    # random order inside each partition; the place is the partition above 33 bits and the position in it
    placed = keyed.sortWithinPartitions("key", "id").withColumn("place", F.monotonically_increasing_id()).drop("key")
    placed = stage(placed, "shard-rows").withColumns(
        {"part": F.shiftrightunsigned("place", 33), "position": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    gives = matrix(counts, shards, seed)
    ends = F.transform("gives", lambda _, k: F.aggregate(F.slice("gives", 1, k + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    dealt = placed.join(gives.select("part", ends.alias("ends")), "part").select(
        "row", "id", "size", "text_crc32", "place", F.size(F.filter("ends", lambda e: e <= F.col("position"))).alias("shard"),
        F.md5(F.concat_ws(":", F.lit(seed), "place").cast("binary")).alias("key"), F.lit(1).cast("long").alias("one"),
    )
    total = placed.count()
    slots = running(dealt, "shard", "key", "one", digits_for(-(-total // shards)), ["place"], "slot")
    return slots.select("row", "id", "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, id_col="doc_id", text_col="text", shards=SHARDS, seed=SEED) -> DataFrame:
    """``docs`` with shard and slot."""
    return spread(shuffle(docs, id_col, text_col, shards, seed), ["shard", "slot"])
