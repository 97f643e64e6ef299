"""Run history: manifests and share summaries of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.operators.jsonld import string_at
from citeframe.sources.sinks import MANIFESTS, SHARES, commits, read_committed


def _number(v, path: str):
    value = F.try_variant_get(v, path, "variant")
    numeric = F.regexp_like(F.schema_of_variant(value), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    return F.when(numeric, F.try_variant_get(v, path, "double"))


def list_runs(manifests: DataFrame, shares: DataFrame) -> DataFrame:
    """Runs with score and visibility from the manifest, else the share summary.

    Both inputs are (run_id, doc). A manifest that is no JSON object with site, summary, artifacts
    and time is skipped; a broken share summary only leaves its values empty.
    """
    m = F.col("_m")
    df = manifests.withColumn("_m", F.try_parse_json("doc")).drop("doc")
    artifacts = F.try_variant_get(m, "$.artifacts", "array<variant>")
    readable = artifacts.isNotNull() & string_at(m, "$.generatedAt").isNotNull()
    readable = readable & F.try_variant_get(m, "$.site", "variant").isNotNull() & F.try_variant_get(m, "$.summary", "variant").isNotNull()
    s = shares.select("run_id", F.try_parse_json("doc").alias("_s"))
    out = df.filter(readable).join(s, "run_id", "left")
    return out.select(
        "run_id",
        string_at(m, "$.kind").alias("kind"),
        string_at(m, "$.generatedAt").alias("generated_at"),
        F.coalesce(string_at(m, "$.site.display"), string_at(m, "$.site.baseUrl"), string_at(m, "$.site.input")).alias("site_label"),
        string_at(m, "$.site.input").alias("site_input"),
        F.coalesce(_number(m, "$.summary.overallScore"), _number(F.col("_s"), "$.metrics.overallScore")).alias("overall_score"),
        _number(F.col("_s"), "$.metrics.vavr").alias("vavr"),
        F.size(artifacts).alias("artifact_count"),
    )


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("generated_at"), "run_id")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs below ``root``, newest first.

    Runs that the writers committed count by site, as ``run_id/site_id``, with the documents of their last committed
    attempt. Below a root without commits each folder is a run, holding run.json and maybe share-summary.json.
    """
    if commits(spark, root).isEmpty():

        def docs(name: str) -> DataFrame:
            files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
            run = F.element_at(F.split("_metadata.file_path", "/"), -2)
            return files.select(run.alias("run_id"), F.col("value").alias("doc"))

        return newest_first(list_runs(docs("run.json"), docs("share-summary.json")))

    def written(name: str) -> DataFrame:
        return read_committed(spark, root, name).select(F.concat_ws("/", "run_id", "site_id").alias("run_id"), "doc")

    return newest_first(list_runs(written(MANIFESTS), written(SHARES)))
