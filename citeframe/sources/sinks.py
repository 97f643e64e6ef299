"""Writers of whole runs, with a commit that comes last.

Every write of a run goes into folders of its own (``<root>/<table>/_run=…/_attempt=…``): tables first, then the
manifest and the share summary of each site, and at the very end one commit row that names run and attempt. Readers
look at committed attempts only, and at the latest one of each run. So a write that breaks is invisible, writing a run
again replaces what readers see of it without touching files that are being read, and nothing is ever doubled.
"""

from __future__ import annotations

import os
import re
import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.operators.answers import payload_file

COMMITS, MANIFESTS, SHARES = "commits", "manifests", "share-summaries"
_COMMIT = "run_id string, attempt string, kind string, committed_at string"


def _place(root: str, table: str, run_id: str, attempt: str) -> str:
    # the leading letter keeps Spark from reading ids as numbers; it decodes the signs that paths cannot hold
    safe = re.sub(r"[^\w.-]", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 128 else m[0], run_id)
    return os.path.join(root, table, f"_run=r{safe}", f"_attempt=a{attempt}")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The attempt that counts of each committed run (run_id, attempt, kind); none below an empty root."""
    try:
        rows = spark.read.schema(_COMMIT).json(os.path.join(root, COMMITS))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _COMMIT)
    last = F.max(F.struct("committed_at", "attempt", "kind")).alias("c")
    return rows.groupBy("run_id").agg(last).select("run_id", "c.attempt", "c.kind")


def read_committed(spark: SparkSession, root: str, table: str, fmt: str = "parquet") -> DataFrame:
    """All rows of a table that belong to committed runs; ``run_id`` is the run's."""
    known = commits(spark, root).select(F.concat(F.lit("r"), "run_id").alias("_run"), F.concat(F.lit("a"), "attempt").alias("_attempt"), F.col("run_id").alias("_id"))
    found = spark.read.option("basePath", os.path.join(root, table)).format(fmt).load(os.path.join(root, table))
    kept = found.drop(*[c for c in found.columns if c == "run_id"]).join(known, ["_run", "_attempt"])
    return kept.withColumnRenamed("_id", "run_id").drop("_run", "_attempt")


def _commit(spark: SparkSession, root: str, run_id: str, attempt: str, kind: str) -> None:
    row = [(run_id, attempt, kind, datetime.now(UTC).isoformat())]
    spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("append").json(os.path.join(root, COMMITS))


def manifest(kind: str, generated_at: str, summary: list[Column], artifacts: list[str]) -> Column:
    """JSON text of a run's manifest for one site; reads the columns site_id and base_url."""
    site = F.struct(F.col("site_id").alias("input"), F.col("base_url").alias("baseUrl"))
    return F.to_json(
        F.struct(
            F.lit(kind).alias("kind"), F.lit(generated_at).alias("generatedAt"), site.alias("site"),
            F.struct(*summary).alias("summary"), F.array(*map(F.lit, artifacts)).alias("artifacts"),
        ),
        {"ignoreNullFields": "false"},
    )


def share_summary(kind: str, generated_at: str, metrics: list[Column]) -> Column:
    """JSON text of a run's share summary for one site."""
    site = F.struct(F.col("site_id").alias("input"), F.col("base_url").alias("baseUrl"))
    return F.to_json(
        F.struct(F.lit(kind).alias("kind"), F.lit(generated_at).alias("generatedAt"), site.alias("site"), F.struct(*metrics).alias("metrics")),
        {"ignoreNullFields": "false"},
    )


def write_run(root: str, run_id: str, kind: str, tables: dict[str, DataFrame], documents: DataFrame | None = None,
              partitions: dict[str, list[str]] | None = None, json: tuple[str, ...] = ()) -> str:
    """Write all tables of a run, then its documents (site_id, manifest, share), then the commit; returns the attempt.

    ``partitions`` names columns that split a table further; tables in ``json`` are written as JSON text.
    """
    attempt = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        rows = df.drop(*[c for c in df.columns if c == "run_id"]).write.partitionBy(*(partitions or {}).get(name, []))
        rows.format("json" if name in json else "parquet").save(_place(root, name, run_id, attempt))
    if documents is not None:
        for name, column in ((MANIFESTS, "manifest"), (SHARES, "share")):
            documents.select("site_id", F.col(column).alias("doc")).where("doc is not null").write.parquet(_place(root, name, run_id, attempt))
    _commit(spark, root, run_id, attempt, kind)
    return attempt


def write_audit(tables: dict[str, DataFrame], sites: DataFrame, root: str, run_id: str, generated_at: str) -> str:
    """All tables of an audit run, a manifest and a share summary for each site of ``audit_summary``."""
    summary = [
        F.col("overall_score").alias("overallScore"), F.col("vavr"), F.col("missing_page_types").alias("missingPageTypes"),
        F.col("crawled_pages").alias("crawledPages"), F.col("discovered_urls").alias("discoveredUrls"), F.col("key_page_count").alias("keyPageCount"),
    ]
    of = tables["audit_summary"].join(sites.select("site_id", "base_url"), "site_id", "left")
    documents = of.select(
        "site_id", manifest("audit", generated_at, summary, sorted(tables)).alias("manifest"),
        share_summary("audit", generated_at, [F.col("overall_score").alias("overallScore"), F.col("vavr")]).alias("share"),
    )
    return write_run(root, run_id, "audit", tables, documents)


def write_eval(tables: dict[str, DataFrame], sites: DataFrame, root: str, run_id: str, generated_at: str) -> str:
    """Answer tables of one run; raw payloads as JSON text by provider under their file key."""
    mine = {name: df.where(F.col("run_id") == run_id) if "run_id" in df.columns else df for name, df in tables.items()}
    documents = None
    if "eval_summary" in mine:
        rates = [c for c in mine["eval_summary"].columns if c not in ("site_id", "run_id", "generated_at")]
        of = mine["eval_summary"].join(sites.select("site_id", "base_url"), "site_id", "left")
        documents = of.select(
            "site_id", manifest("eval", generated_at, [F.lit(None).cast("int").alias("overallScore"), *map(F.col, rates)], sorted(mine)).alias("manifest"),
            share_summary("eval", generated_at, [F.lit(None).cast("int").alias("overallScore"), *map(F.col, rates)]).alias("share"),
        )
    if "raw_payloads" in mine:
        mine["raw_payloads"] = payload_file(mine["raw_payloads"]).select("provider", "raw_payload_file", "raw_payload")
    return write_run(root, run_id, "eval", mine, documents, {"raw_payloads": ["provider"]}, ("raw_payloads",))


def write_validation(tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Search tables by source; submission candidates have no source and go out as they are."""
    by_source = {name: ["source"] for name, df in tables.items() if "source" in df.columns}
    return write_run(root, run_id, "validation", tables, partitions=by_source)
