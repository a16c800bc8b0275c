"""Spark session defaults and the shared checkpoint folder.

On a cluster the operator reads ``spark.checkpoint.dir`` from the session
(the cluster names a shared folder there). Only where it is unset and Spark runs
in this process (tests) do we point it at a fresh scratch folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "wearline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("WEARLINE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. A scratch folder is made only where none is
    set and Spark runs in this process; on a cluster that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="wearline-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new name for a folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later
    plans start from columns that survive executor loss and can be pruned."""
    spark = df.sparkSession
    at = scratch(spark, "stored")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def store_in_tasks(df: DataFrame, rows_a_task: int) -> DataFrame:
    """``store`` for wide rows that later scans hold: a task reads about ``rows_a_task``
    rows or fewer, however many there are. Spark packs small files into as many tasks as there
    are cores, so a large table is read as a union of as many files at a time."""
    spark = df.sparkSession
    at = scratch(spark, "stored")
    df.write.option("maxRecordsPerFile", rows_a_task).parquet(at)
    whole = spark.read.schema(df.schema).parquet(at)
    cores = max(1, spark.sparkContext.defaultParallelism)
    if whole.count() <= cores * rows_a_task:
        return whole
    files = sorted(whole.inputFiles())
    out = None
    for i in range(0, len(files), cores):
        part = spark.read.schema(df.schema).parquet(*files[i:i + cores])
        out = part if out is None else out.unionByName(part)
    return out
