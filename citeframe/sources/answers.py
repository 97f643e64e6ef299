"""Imported answers and stored provider payloads (native Variant columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.operators.jsonld import as_list, is_object, string_at

_CITATION = "array<struct<url:string,title:string,owned:boolean,trusted:boolean>>"


def _items(doc: Column) -> Column:
    """The responses of an import: the array itself, or the array under ``responses``."""
    return F.coalesce(
        F.try_variant_get(doc, "$", "array<variant>"), F.try_variant_get(doc, "$.responses", "array<variant>")
    )


def _boolean(v: Column, path: str) -> Column:
    value = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def _citation(c: Column) -> Column:
    plain = F.when(F.schema_of_variant(c) == "STRING", c.cast("string"))
    return F.struct(
        F.coalesce(plain, string_at(c, "$.url")).alias("url"),
        string_at(c, "$.title").alias("title"),
        _boolean(c, "$.owned").alias("owned"),
        _boolean(c, "$.trusted").alias("trusted"),
    )


def import_answers(raw: DataFrame, locale: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers and rejects of import documents (site_id, run_id, doc).

    A document is an array of responses or an object with a ``responses`` array; provider, model,
    locale and run count of the wrapper are defaults for its responses.
    """
    df = raw.withColumn("_doc", F.try_parse_json("doc")).withColumn("_items", _items(F.col("_doc")))
    broken = df.filter("_items IS NULL").select(
        "site_id", "run_id", F.lit(None).cast("int").alias("answer_ord"), F.lit(None).cast("string").alias("prompt_id"),
        F.lit("no array of responses").alias("reason"),
    )
    rows = df.select("site_id", "run_id", "_doc", F.posexplode("_items").alias("answer_ord", "r"))
    r, doc = F.col("r"), F.col("_doc")
    rank = F.try_variant_get(r, "$.rankPosition", "variant")
    has_rank = rank.isNotNull() & ~F.is_variant_null(rank)
    rank_value = F.when(
        F.regexp_like(F.schema_of_variant(rank), F.lit("^(BIGINT|DOUBLE|DECIMAL.*)$")),
        F.try_variant_get(r, "$.rankPosition", "double"),
    )
    given = F.transform(as_list(r, "$.citations"), _citation)
    fields = rows.select(
        "site_id", "run_id", F.col("answer_ord").cast("long").alias("answer_ord"),
        string_at(r, "$.promptId").alias("prompt_id"),
        F.coalesce(F.try_variant_get(r, "$.sampleIndex", "int"), F.lit(0)).alias("sample_index"),
        F.coalesce(string_at(r, "$.provider"), string_at(doc, "$.provider"), F.lit("manual")).alias("provider"),
        F.coalesce(string_at(r, "$.model"), string_at(doc, "$.model"), F.lit("manual-import")).alias("model"),
        string_at(r, "$.answerText").alias("answer_text"),
        F.coalesce(string_at(r, "$.locale"), string_at(doc, "$.locale"), F.lit(locale).cast("string")).alias("locale"),
        rank_value.cast("int").alias("rank_position"),
        F.lit("manual-import").alias("mode"),
        given.cast(_CITATION).alias("citations"),
        F.coalesce(F.try_variant_get(r, "$.runCount", "int"), F.try_variant_get(doc, "$.runCount", "int"), F.lit(1)).alias("run_count"),
        F.coalesce(F.try_variant_get(r, "$.rawPayload", "variant"), r).cast("string").alias("raw_payload"),
        (has_rank & (rank_value.isNull() | (rank_value < 1) | (rank_value != F.floor(rank_value)))).alias("_bad_rank"),
    )
    no_url = F.exists("citations", lambda c: F.length(F.coalesce(c["url"], F.lit(""))) == 0)
    reason = (
        F.when(F.length(F.coalesce("prompt_id", F.lit(""))) == 0, F.lit("promptId is missing"))
        .when(F.col("answer_text").isNull(), F.lit("answerText is missing"))
        .when(no_url, F.lit("a citation has no url"))
        .when(F.coalesce("_bad_rank", F.lit(False)), F.lit("rankPosition is no positive integer"))
    )
    checked = fields.withColumn("reason", reason).drop("_bad_rank")
    bad = checked.filter("reason IS NOT NULL").select(
        "site_id", "run_id", F.col("answer_ord").cast("int").alias("answer_ord"), "prompt_id", "reason"
    )
    return checked.filter("reason IS NULL").drop("reason"), broken.unionByName(bad)


def read_answers(spark: SparkSession, path: str, site_id: str, run_id: str, locale: str | None = None,
                 lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Answers and rejects of import files.

    A file is one JSON document (an array, or a wrapper with defaults), which one task reads as it has to be parsed as
    a whole; with ``lines`` every line of a file is one response, or a document of its own, and a file of any size is
    read by many tasks. ``answer_ord`` then counts within a line's document.
    """
    files = spark.read.text(path, wholetext=not lines)
    if lines:
        text = F.trim(F.regexp_replace("value", "^\ufeff", ""))
        parsed = F.try_parse_json(text)
        alone = is_object(parsed) & F.try_variant_get(parsed, "$.responses", "array<variant>").isNull()
        files = files.where(F.length(text) > 0).select(F.when(F.coalesce(alone, F.lit(False)), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text).alias("value"))
    raw = files.select(F.lit(site_id).alias("site_id"), F.lit(run_id).alias("run_id"), F.col("value").alias("doc"))
    return import_answers(raw, locale)


def _first_of_each(rows: Column, field: str = "url") -> Column:
    """Keep the first struct of each value of ``field``."""
    values = F.transform(rows, lambda x: x[field])
    return F.filter(rows, lambda x, i: F.array_position(values, x[field]) == i + 1)


def _nested(v: Column, *paths: str) -> Column:
    """All values below a chain of array-or-object steps."""
    level = as_list(v, paths[0])
    for path in paths[1:]:
        level = F.flatten(F.transform(level, lambda x: as_list(x, path)))
    return level


def _of_type(values: Column, name: str) -> Column:
    return F.filter(values, lambda x: F.coalesce(string_at(x, "$.type") == name, F.lit(False)))


_KEPT = ["site_id", "run_id", "prompt_id", "sample_index", "provider"]


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    answers = df.select(*_KEPT, "answer_text", "citations")
    citations = df.select(*_KEPT, F.posexplode("citations").alias("cit_ord", "c")).select(*_KEPT, "cit_ord", "c.*")
    sources = df.select(*_KEPT, F.posexplode("sources").alias("src_ord", "s")).select(*_KEPT, "src_ord", "s.*")
    return answers, citations, sources


def _plain_citation(url: Column, title: Column) -> Column:
    none = F.lit(None).cast("boolean")
    return F.struct(url.alias("url"), title.alias("title"), none.alias("owned"), none.alias("trusted"))


def normalize_payloads_a(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, citations and sources of payloads built from output items.

    Text comes from ``output_text`` or else from the message parts; citations from the url_citation
    annotations; sources from the web search calls. Repeated urls keep the first.
    """
    p = F.col("_p")
    df = raw.withColumn("_p", F.try_parse_json("payload"))
    df = df.withColumn("_out", F.coalesce(F.try_variant_get(p, "$.output", "array<variant>"), F.array().cast("array<variant>")))
    parts = F.flatten(F.transform(_of_type(F.col("_out"), "message"), lambda m: as_list(m, "$.content")))
    df = df.withColumn("_parts", parts)
    texts = F.filter(F.transform("_parts", lambda c: string_at(c, "$.text")), lambda t: t.isNotNull())
    direct = string_at(p, "$.output_text")
    notes = _of_type(F.flatten(F.transform("_parts", lambda c: as_list(c, "$.annotations"))), "url_citation")
    cited = F.transform(notes, lambda a: _plain_citation(string_at(a, "$.url"), string_at(a, "$.title")))
    calls = _of_type(F.col("_out"), "web_search_call")
    found = F.flatten(F.transform(calls, lambda c: as_list(c, "$.action.sources")))
    sources = F.transform(
        found,
        lambda s: F.struct(
            string_at(s, "$.url").alias("url"), string_at(s, "$.title").alias("title"),
            F.coalesce(string_at(s, "$.date"), string_at(s, "$.published_at")).alias("date"),
            string_at(s, "$.snippet").alias("snippet"), F.lit("web").alias("source"),
        ),
    )
    df = df.withColumns(
        {
            "answer_text": F.when(F.length(direct) > 0, direct).otherwise(F.trim(F.array_join(texts, "\n\n"))),
            "citations": F.filter(cited, lambda c: F.length(c["url"]) > 0),
            "sources": F.filter(sources, lambda s: s["url"].isNotNull()),
        }
    ).drop("_p", "_out", "_parts")
    df = df.withColumns({"citations": _first_of_each(F.col("citations")), "sources": _first_of_each(F.col("sources"))})
    return _split(df)


def normalize_payloads_b(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, citations and sources of payloads built from choices.

    Citations are plain urls; their titles are looked up in the search results, where the last
    result of a url counts.
    """
    p = F.col("_p")
    df = raw.withColumn("_p", F.try_parse_json("payload"))
    results = F.filter(
        F.coalesce(F.try_variant_get(p, "$.search_results", "array<variant>"), F.array().cast("array<variant>")), is_object
    )
    sources = F.transform(
        results,
        lambda s: F.struct(
            string_at(s, "$.url").alias("url"), string_at(s, "$.title").alias("title"),
            F.coalesce(string_at(s, "$.date"), string_at(s, "$.last_updated")).alias("date"),
            string_at(s, "$.snippet").alias("snippet"),
            F.coalesce(string_at(s, "$.source"), F.lit("web")).alias("source"),
        ),
    )
    cited = F.filter(
        F.coalesce(F.try_variant_get(p, "$.citations", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: F.schema_of_variant(c) == "STRING",
    )
    df = df.withColumns(
        {
            "answer_text": F.coalesce(F.trim(string_at(p, "$.choices[0].message.content")), F.lit("")),
            "sources": F.filter(sources, lambda s: s["url"].isNotNull()),
            "_urls": F.array_distinct(F.transform(cited, lambda c: c.cast("string"))),
        }
    ).drop("_p")

    def titled(url: Column) -> Column:
        last = F.try_element_at(F.filter("sources", lambda s: s["url"] == url), F.lit(-1))
        return _plain_citation(url, last["title"])

    df = df.withColumn("citations", F.transform("_urls", titled))
    return _split(df.drop("_urls"))
