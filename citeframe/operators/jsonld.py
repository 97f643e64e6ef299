"""JSON-LD records and their visibility (native Variant columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe import constants as C
from citeframe.functions import text as T


def as_list(v: Column, path: str) -> Column:
    """Variant at ``path`` as an array: arrays as they are, one value as one element, nothing as none."""
    many = F.try_variant_get(v, path, "array<variant>")
    one = F.try_variant_get(v, path, "variant")
    present = one.isNotNull() & ~F.is_variant_null(one)
    return F.coalesce(many, F.when(present, F.array(one)), F.array().cast("array<variant>"))


def string_at(v: Column, path: str) -> Column:
    """String at ``path``; NULL when the value there is no string."""
    value = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, path, "string"))


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def first_present(v: Column, *paths: str) -> Column:
    """The value at the first path that holds one, if that value is a string."""
    chosen = F.lit(None).cast("string")
    for path in reversed(paths):
        here = F.try_variant_get(v, path, "variant")
        chosen = F.when(here.isNotNull() & ~F.is_variant_null(here), string_at(v, path)).otherwise(chosen)
    return chosen


def _questions(node: Column) -> Column:
    def pair(q: Column) -> Column:
        answer = F.get(F.filter(as_list(q, "$.acceptedAnswer"), is_object), F.lit(0))
        return F.struct(
            F.coalesce(T.clean_text(first_present(q, "$.name", "$.text"), 140), F.lit("")).alias("question"),
            F.coalesce(T.clean_text(first_present(answer, "$.text", "$.name"), 180), F.lit("")).alias("answer"),
        )

    asked = F.transform(F.filter(as_list(node, "$.mainEntity"), is_object), pair)
    return F.filter(asked, lambda p: (F.length(p["question"]) > 0) | (F.length(p["answer"]) > 0))


def _types(node: Column) -> Column:
    strings = F.filter(as_list(node, "$['@type']"), lambda t: F.schema_of_variant(t) == "STRING")
    names = F.transform(strings, lambda t: T.trimmed(t.cast("string")))
    return F.filter(names, lambda t: F.length(t) > 0)


def _supported(name: Column) -> Column:
    known = F.lit(None).cast("string")
    for record_type in C.JSONLD_RECORD_TYPES:
        known = F.when(F.lower(name) == record_type.lower(), F.lit(record_type)).otherwise(known)
    return known


def with_jsonld(pages: DataFrame) -> DataFrame:
    """Adds ``jsonld_types`` (distinct, first seen first) and ``jsonld_records`` of the supported types."""
    # Pages without JSON-LD have an empty node array, so none of this runs for them.
    parsed = F.transform("jsonld_nodes", lambda j: F.try_parse_json(j))
    typed = F.transform(parsed, lambda n: F.struct(n.alias("node"), _types(n).alias("types")))
    df = pages.withColumn("_typed", typed)

    def record(n: Column, kind: Column) -> Column:
        faq = F.when(kind == "FAQPage", _questions(n)).otherwise(
            F.array().cast("array<struct<question:string,answer:string>>")
        )
        return F.struct(
            kind.alias("type"),
            T.clean_text(string_at(n, "$.name")).alias("name"),
            T.clean_text(string_at(n, "$.description")).alias("description"),
            T.clean_text(string_at(n, "$.url")).alias("url"),
            T.clean_text(first_present(n, "$.applicationCategory", "$.category")).alias("category"),
            faq.alias("questions"),
        )

    def records(t: Column) -> Column:
        kinds = F.filter(F.transform(t["types"], _supported), lambda k: k.isNotNull())
        return F.transform(kinds, lambda k: record(t["node"], k))

    return df.withColumns(
        {
            "jsonld_types": F.array_distinct(F.flatten(F.transform("_typed", lambda t: t["types"]))),
            "jsonld_records": F.flatten(F.transform("_typed", records)),
        }
    ).drop("_typed")


def explode_jsonld(pages: DataFrame) -> DataFrame:
    """Long JSON-LD table, one row per supported record of a page."""
    source = pages if "jsonld_records" in pages.columns else with_jsonld(pages)
    return source.select("site_id", "url", F.posexplode("jsonld_records").alias("record_ord", "r")).select(
        "site_id", "url", "record_ord", "r.*"
    )


def with_schema_signals(pages: DataFrame) -> DataFrame:
    """Adds ``schema_signals``: every named field of a record and whether the page text shows it.

    Visible means the squashed value occurs in the text, or 0.55 of its keyword tokens do.
    """
    lower = F.col("_shown")

    def signal(kind: Column, field: str, value: Column) -> Column:
        wanted = T.squash(F.lower(value))
        seen = F.contains(lower, wanted) | (T.keyword_coverage(lower, value) >= 0.55)
        return F.struct(
            kind.alias("record_type"), F.lit(field).alias("field"), value.alias("value"), seen.alias("visible")
        )

    def of_record(r: Column) -> Column:
        named = F.array(*[signal(r["type"], f, r[f]) for f in ("name", "description", "category")])
        asked = F.flatten(
            F.transform(
                r["questions"],
                lambda q: F.array(
                    signal(r["type"], "faq.question", q["question"]), signal(r["type"], "faq.answer", q["answer"])
                ),
            )
        )
        return F.filter(F.concat(named, asked), lambda s: F.length(s["value"]) > 0)

    df = pages.withColumn("_shown", F.lower("body_text"))  # P1 squashed it already
    return df.withColumn("schema_signals", F.flatten(F.transform("jsonld_records", of_record))).drop("_shown")


def schema_signals(pages: DataFrame) -> DataFrame:
    """Long table of schema text signals."""
    source = pages if "schema_signals" in pages.columns else with_schema_signals(with_jsonld(pages))
    return source.select("site_id", "url", F.posexplode("schema_signals").alias("signal_ord", "s")).select(
        "site_id", "url", "signal_ord", "s.*"
    )
