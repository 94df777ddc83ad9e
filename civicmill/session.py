"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE and its skew-join split stay on: they handle hot keys in the equi-joins.
# Broadcasts are left to the size estimates and runtime sizes Spark itself checks.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "civicmill", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in ``spark.checkpoint.dir``.

    Only on a local master, where driver and executors are one process, may the setting be absent: a local folder is
    then made, once per session. Anywhere else that would leave each executor's files on its own disk, so it raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {context.master})")
    if getattr(context, "_civicmill_dir", None) is None:
        context._civicmill_dir = tempfile.mkdtemp(prefix="civicmill-")
    return context._civicmill_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's own folder of scratch tables, ``civicmill-<application id>``.

    Results may still read the tables after a query returns, so nothing here is removed by the library: whoever runs
    the application removes its one folder when it has ended.
    """
    return os.path.join(shared_dir(spark), f"civicmill-{spark.sparkContext.applicationId}", f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as a table written in the shared folder: its sizes are known, its columns can be pruned, and it
    survives the loss of an executor."""
    path = scratch_path(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
