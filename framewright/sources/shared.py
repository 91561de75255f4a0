"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where it is unset and Spark runs on this machine alone."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir() or ""
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="framewright-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def tasks(spark: SparkSession) -> int:
    """Tasks for a step over many small things: three a core, or the session's shuffle partitions if these are more."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows dealt by keys to that many tasks, for steps that make much of each row: small tables lie in one or two partitions.

    The number is named, so adaptive execution leaves it as it is.
    """
    return rows.repartition(tasks(rows.sparkSession), *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
