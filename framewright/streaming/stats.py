"""Running statistics as files arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pixels import channel_stats
from ..sources.shared import shared_folder
from .store import ResultStore


def streaming_channel_stats(stream: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """The streaming aggregate (keys, n, mean, std) over everything seen so far, for output mode complete."""
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def streaming_image_stats(stream: DataFrame, keys: tuple[str, ...] = (), data: str = "data", channels: int = 3, ddof: int = 1) -> DataFrame:
    """(keys, channel, mean, std) over every pixel of every image seen so far: the state holds sums for each key and channel."""
    return channel_stats(stream, data, channels, ddof, keys)


def run_available(stats: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Run a streaming aggregate over the files that came since the last run with this checkpoint; its result so far.

    With a checkpoint, results stand in `results` beside the query's state, so a run that finds no new file returns
    what the run before it returned, and a run in another session goes on from there. Without one, each call starts anew.
    A checkpoint belongs to one query: its schema and keys may not change.
    """
    spark = stats.sparkSession
    folder = checkpoint.rstrip("/") if checkpoint else f"{shared_folder(spark)}/stats-{uuid.uuid4().hex}"
    store = ResultStore(spark, f"{folder}/results")
    writer = stats.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(store.write)
    query = writer.start()
    query.awaitTermination()
    last = store.latest(stats.schema)
    return spark.createDataFrame([], stats.schema) if last is None else last
