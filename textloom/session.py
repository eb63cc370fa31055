"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read lazily by Spark's own reader."""
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table for a kernel, dealt over all cores where the files give fewer tasks: short rows of which long texts
    are made fit into one small file."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(3 * n)


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share, ``spark.checkpoint.dir``. Where the session leaves
    that unset and runs on one machine (as in tests) a temporary folder is set; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of an iterative computation: a checkpoint in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark, "cut"))
    return df.checkpoint()
