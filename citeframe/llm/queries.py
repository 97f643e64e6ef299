"""The registered queries: each applies its operator to a whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm import alignment, content, decontaminate, languages, mixing, personal, quality, secrets, sharding, simhash, substrings, variants, vectors

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce('s' || source, 't') AS source_key, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
),
sources AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY 1),
ranked AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source_key) - 1) % 3) + 1]::DOUBLE AS weight,
         2 * source_size::DOUBLE AS cap
  FROM sources
),
filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM ranked
),
level AS (SELECT * FROM filled WHERE weight * rest / weight_left < cap ORDER BY weight_left DESC LIMIT 1),
targets AS (
  SELECT f.source_key, f.source_size,
         CASE WHEN f.weight * f.rest / f.weight_left < f.cap
              THEN f.weight * (SELECT rest FROM level) / (SELECT weight_left FROM level) ELSE f.cap END AS target
  FROM filled f
),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source_key ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs
),
cut AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(floor(t.target + 0.5) / t.source_size) ELSE 0 END AS passes
  FROM placed p JOIN targets t USING (source_key)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(passes * size + greatest(0, least(floor(target + 0.5) - passes * source_size - start, size)) AS BIGINT) AS taken
FROM cut
"""


@query("op1_source_mixing", MIX_SQL)
def op1(spark, sf):
    out = mixing.mix(table(spark, sf, "documents"), payload=["doc_id"])
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op2_secret_scan")
def op2(spark, sf):
    found = secrets.scan(table(spark, sf, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), secrets.number(0).alias("n_assign"), secrets.number(1).alias("n_access"),
        secrets.number(2).alias("n_hex"), F.sha2(secrets.listed("base").cast("binary"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


@query("op3_sharding")
def op3(spark, sf):
    out = sharding.shuffle(table(spark, sf, "documents"), payload=["doc_id"])
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


VECTOR_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op4_vector_topk", VECTOR_SQL)
def op4(spark, sf):
    return vectors.top(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op5_personal_data")
def op5(spark, sf):
    found = personal.scan(table(spark, sf, "documents"))
    counts = [personal.number(k).alias(f"n_{kind}") for k, kind in enumerate(personal.BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(personal.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(personal.listed(base).cast("binary"), 256).alias("base_sha256"),
        personal.listed("spans").alias("spans"),
    )


@query("op6_main_text")
def op6(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", "url", content.main_text(pages["html"]).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_quality")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    scored = docs.select("doc_id", quality.held_out("doc_id").alias("held_out"), quality.score(model, docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op8_decontamination")
def op8(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_repeated_spans")
def op9(spark, sf):
    out = substrings.repeated_spans(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op10_simhash")
def op10(spark, sf):
    rows, classes = simhash.near_duplicates(table(spark, sf, "documents"), payload=["doc_id"])
    return rows.hint("merge").join(classes, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op12_language_id")
def op12(spark, sf):
    docs = table(spark, sf, "documents")
    field = languages.train(docs)
    found = docs.select("doc_id", languages.held_out("doc_id").alias("held_out"), languages.language(field, docs["text"]).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


TOKENIZERS = "/opt/tokenizers"


@query("op13_token_alignment")
def op13(spark, sf):
    docs = table(spark, sf, "documents")
    first, second = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    return alignment.align(docs, first, second, payload=["doc_id"])


VARIANT_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) AS x GROUP BY 1, 2
),
coded AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes
  FROM runs
),
summed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda b: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: ((b >> i) & 1)::BIGINT)))),
    lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) AS h
  FROM coded
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM summed
  ) AS x WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
),
less AS (
  SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS d FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM words) AS x
),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM less AS a JOIN less AS b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT w.word, l.word FROM words AS w JOIN less AS l ON l.d = w.word
  UNION SELECT l.word, w.word FROM words AS w JOIN less AS l ON l.d = w.word
),
ranked AS (
  SELECT p.x, p.y, w.n, count(*) OVER (PARTITION BY p.x) AS n_near, row_number() OVER (PARTITION BY p.x ORDER BY w.n DESC, p.y) AS r
  FROM pairs AS p JOIN words AS w ON w.word = p.y
),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.y END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words AS w LEFT JOIN ranked AS r ON r.x = w.word AND r.r = 1
),
chains AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chains AS c JOIN forms AS f ON f.word = c.root AND f.form IS NOT NULL
),
roots AS (SELECT word, arg_max(root, step) AS root FROM chains GROUP BY 1)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms AS f JOIN roots AS r USING (word)
"""


@query("op11_spelling_variants", VARIANT_SQL)
def op11(spark, sf):
    return variants.variants(variants.word_counts(table(spark, sf, "documents"), change=variants.misspelt))
