"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators count on; a cluster's own values win where set.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = 8, name: str = "costspark", **conf: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, path: str | None = None) -> str:
    """The folder that driver and executors share.

    In this order: ``path``, ``spark.checkpoint.dir``, the session's checkpoint folder.  Without
    any, a single-machine session takes a temporary folder; a cluster gets an error, since
    each executor would write to a disk of its own.
    """
    base = path or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("no shared folder: set spark.checkpoint.dir or give a path")
        base = _fallback_dir()
    return base.rstrip("/")


@functools.cache
def _fallback_dir() -> str:
    return tempfile.mkdtemp(prefix="costspark-")


def scratch_path(spark: SparkSession, name: str, path: str | None = None) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark, path)}/costspark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet and return a frame that reads it back.

    The written table replaces the lineage, so work after it survives the loss
    of executors without recomputing what came before.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
