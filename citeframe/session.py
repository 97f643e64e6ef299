"""Session defaults and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

# Arrow batches stay small because one row can hold a whole html page.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def tuned(builder):
    """Apply the defaults to a session builder."""
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Executors of a cluster cannot see a folder of the driver, so an unset folder is an error there; only a
    ``local`` master gets a fresh one, with a warning.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="citeframe-")
        warnings.warn(f"spark.checkpoint.dir is not set; staging in {folder}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Consumers then prune columns, the lineage is cut, and lost executors only cost a re-read.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "citeframe-stages", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
