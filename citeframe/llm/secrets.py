"""Secret scans: fixed patterns plus character Markov models compared by log-likelihood ratio.

Three patterns find assignments, access keys and hexadecimal keys; matches that are too short are dropped. Tokens of
``TOKEN`` characters or more outside those spans (shorter ones hold too little evidence) are then judged by two
first-order Markov models over characters, one of random strings and one of ordinary identifiers, both trained from
labelled samples: a token whose log-likelihood ratio is high, in all and per character, is added with kind
``markov``. Counting, smoothing and scoring are SQL functions; the models are one array of 128 x 128 ratios.

Without samples of its own the scan makes them, as many as there are rows. Random strings: the values of base spans
and digests of the row written in 64 signs, in letters and digits, and in capitals and digits. Ordinary strings: every
distinct token of ``WORD`` characters or more outside base spans, neighbouring words of each text as identifiers
(camel and snake case, constants, paths, with numbers), and UUIDs, plain and hexadecimal numbers, dates, versions and
rows of one mark.

Positions are running sums over the lengths of matches and of the pieces between them, in chunks, so that time grows
with the number of matches. The texts are scanned once; what was found is written and scored from there.

Defined cases: null texts count as empty and have no spans. Characters beyond ASCII share the last row of the
models. Without samples of random strings their model is uniform. Repeated rows and null ids are rows like any
other; an empty table gives an empty result. Extra columns are left out by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeframe.functions.text import let
from citeframe.session import stage

# fixed values: patterns and least lengths of the base kinds
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

TOKEN, WORD = 20, 4
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{TOKEN},}}"
ORDINARY = rf"[A-Za-z0-9+/_=.:-]{{{WORD},}}"
CHUNK = 128
RATIO = 10.0
PER_CHARACTER = 0.5
SMOOTHING = 0.1
CODES = 128


def before(sizes: Column) -> Column:
    """Sum of all sizes before each one, by sums within chunks and over the chunks."""

    def running(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def chunked(s: Column) -> Column:
        chunks = F.floor((F.size(s) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), chunks), lambda c: running(F.slice(s, c * CHUNK + 1, F.lit(CHUNK))))

    def shifted(sums: Column, offsets: Column) -> Column:
        own = F.zip_with(sums, F.slice(offsets, F.lit(1), F.size(sums)), lambda p, o: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + o))
        return F.flatten(own)

    return let(sizes, lambda s: let(chunked(s), lambda sums: let(running(F.transform(sums, lambda p: F.element_at(p, -1))), lambda offsets: shifted(sums, offsets))))


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of (start, kind, end, value)."""
    hits, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    parts = F.zip_with(
        F.split(text, pattern, -1), F.zip_with(hits, values, lambda h, v: F.struct(h.alias("hit"), v.alias("value"))),
        lambda gap, h: F.struct(F.length(gap).alias("gap"), F.length(h["hit"]).alias("n"), h["value"].alias("value")),
    )

    def placed(p: Column) -> Column:
        places = before(F.transform(p, lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0))))
        return F.zip_with(
            p, places,
            lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("end"), x["value"].alias("value")),
        )

    spans = F.filter(let(parts, placed), lambda s: s["end"].isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start: int, kind: int, end: int, value: string>>"))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds."""
    assign = F.filter(matches(text, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= ASSIGN_VALUE)
    return F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))


def pairs(token: Column) -> Column:
    """Numbers of the character pairs of a token."""
    codes = F.transform(F.split(token, ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1))), lambda a, b: a * CODES + b)


def train(samples: DataFrame) -> DataFrame:
    """One row with the log ratios of all character pairs; samples: token, label (1 random, 0 ordinary)."""
    counts = samples.select("label", F.explode(pairs(F.col("token"))).alias("pair")).groupBy("pair").agg(
        F.sum("label").alias("random"), F.sum(1 - F.col("label")).alias("ordinary")
    )
    grid = samples.sparkSession.range(CODES * CODES).select(F.col("id").cast("int").alias("pair"))
    first = Window.partitionBy(F.floor(F.col("pair") / CODES))
    full = grid.join(counts, "pair", "left").na.fill(0, ["random", "ordinary"])

    def chance(c):
        return (F.col(c) + SMOOTHING) / (F.sum(c).over(first) + SMOOTHING * CODES)

    ratios = full.select("pair", F.log(chance("random") / chance("ordinary")).alias("ratio"))
    table = F.array_sort(F.collect_list(F.struct("pair", "ratio")))
    return ratios.agg(F.transform(table, lambda x: x["ratio"]).alias("ratios"))


def made_samples(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(token, label): labelled strings made from the rows, random (1) and ordinary (0), each distinct one once."""
    seed = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.xxhash64("text"))
    digest, number = F.unhex(F.sha2(seed.cast("binary"), 512)), F.xxhash64(seed)
    signs = F.base64(digest)
    plain = F.regexp_replace(signs, "[^A-Za-z0-9]", "")
    made = F.array(F.substring(signs, 1, 40), F.substring(plain, 11, 32), F.substring(F.regexp_replace(signs, "[^A-Z0-9]", ""), 1, 20))
    base = found.select(F.explode("base.value").alias("token")).union(texts.select(F.explode(made).alias("token")))
    hexed = F.md5(seed.cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(hexed, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    digits = F.concat(F.abs(number % 10**12).cast("string"), F.abs(F.shiftright(number, 17) % 10**12).cast("string"))
    small = F.pmod(number, F.lit(100)).cast("string")
    moment = F.timestamp_seconds(F.pmod(number, F.lit(2 * 10**9)))
    version = F.concat(F.lit("v"), small, F.lit("."), F.pmod(F.shiftright(number, 9), F.lit(30)).cast("string"), F.lit(".0-rc"), F.pmod(F.shiftright(number, 20), F.lit(9)).cast("string"))
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) >= 2)

    def named(w: Column) -> Column:
        parts = F.slice(w, F.pmod(number, F.greatest(F.size(w) - 3, F.lit(1))).cast("int") + 1, 4)
        low = F.lower(F.array_join(parts, "_"))
        camel = F.replace(F.initcap(F.replace(low, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
        return F.array(low, F.upper(low), camel, F.concat(camel, small), F.concat(low, F.lit("_"), small), F.replace(low, F.lit("_"), F.lit("/")), F.replace(low, F.lit("_"), F.lit("-")))

    other = F.array(uuid, digits, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(moment, "yyyyMMdd-HHmmss"), version, F.substring(hexed, 1, 16))
    rules = F.array(*(F.repeat(F.lit(mark), F.pmod(number, F.lit(40)).cast("int") + 3) for mark in "_-=+/.:"))
    kinds = texts.select(F.explode(F.concat(other, rules, let(words, named))).alias("token"))
    # words and numbers of the texts themselves; what base patterns match is cut out first
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    own = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(ORDINARY), F.lit(0)))).alias("token")).where(F.length("token") < TOKEN)
    label = lambda df, x: df.where("length(token) > 1").distinct().withColumn("label", F.lit(x))
    return label(base, 1).union(label(kinds.union(own), 0))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", samples: DataFrame | None = None) -> DataFrame:
    """(id, base, spans): base and all spans of each row, in order of start and kind.

    ``samples`` are (token, label), label 1 for random strings; without them they are made from the rows.
    """
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = stage(
        texts.select("id", base_spans(F.col("text")).alias("base"), matches(F.col("text"), CANDIDATE, 3).alias("tokens")),
        "secret-spans",
    )
    samples = made_samples(texts, found) if samples is None else samples
    # a model has 128 x 128 numbers, whatever it was trained on
    table = train(samples).select(F.to_json("ratios")).first()[0]
    ratios = F.from_json(F.lit(table), "array<double>")

    def score(token: Column) -> Column:
        return F.aggregate(pairs(token), F.lit(0.0), lambda a, p: a + F.element_at(ratios, p + 1))

    def random(span: Column) -> Column:
        return F.exists(F.array(score(span["value"])), lambda s: (s >= RATIO) & (s >= PER_CHARACTER * F.length(span["value"])))

    def apart(span: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    added = F.filter("tokens", lambda s: apart(s) & random(s))
    return found.select("id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def number(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
