"""Training histories (run_id, phase, epoch, batch_idx, batch_size, loss, metrics) and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("run_id", "phase", "epoch")


def epoch_loss(history: DataFrame) -> DataFrame:
    return history.groupBy(*KEYS).agg((F.sum(F.col("loss") * F.col("batch_size")) / F.sum("batch_size")).alias("loss"))


def epoch_metrics(history: DataFrame) -> DataFrame:
    """(run_id, phase, epoch, metric, value), weighted by batch size."""
    long = history.select(*KEYS, "batch_size", F.explode("metrics").alias("metric", "value"))
    return long.groupBy(*KEYS, "metric").agg((F.sum(F.col("value") * F.col("batch_size")) / F.sum("batch_size")).alias("value"))


def running_batch_mean(history: DataFrame) -> DataFrame:
    """history with running_loss: the weighted mean of the epoch so far."""
    so_far = Window.partitionBy(*KEYS).orderBy("batch_idx").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("running_loss", F.sum(F.col("loss") * F.col("batch_size")).over(so_far) / F.sum("batch_size").over(so_far))


def improvements(epochs: DataFrame, metric: str | None = None) -> DataFrame:
    """epochs (run_id, epoch, loss or metric) with improved: strictly better than all before; a metric also above 0."""
    before = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    if metric:
        better = F.col(metric) > F.greatest(F.coalesce(F.max(metric).over(before), F.lit(0.0)), F.lit(0.0))
    else:
        better = F.col("loss") < F.coalesce(F.min("loss").over(before), F.lit(float("inf")))
    return epochs.withColumn("improved", better)


def best_epoch(epochs: DataFrame, metric: str | None = None) -> DataFrame:
    """The epoch kept per run: its last improvement."""
    kept = improvements(epochs, metric).where("improved")
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("epoch")))).where("_r = 1").drop("_r", "improved")


def early_stop(epochs: DataFrame, patience: int) -> DataFrame:
    """(run_id, stop_epoch): the first epoch `patience` after the last improvement; null if none, or patience <= 1."""
    flagged = improvements(epochs)
    upto = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    waited = F.col("epoch") - F.last(F.when(F.col("improved"), F.col("epoch")), ignorenulls=True).over(upto)
    stop = flagged.withColumn("_w", waited).groupBy("run_id").agg(F.min(F.when(F.col("_w") >= patience, F.col("epoch"))).alias("stop_epoch"))
    return stop if patience > 1 else stop.withColumn("stop_epoch", F.lit(None).cast("int"))


def truncate_history(history: DataFrame, stops: DataFrame) -> DataFrame:
    """history up to each run's stop epoch."""
    return history.join(stops, "run_id", "left").where("stop_epoch is null or epoch <= stop_epoch").drop("stop_epoch")


def global_rank(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """rows with the 1-based position in the order of all rows, without sorting them in one task.

    Rows are dealt by ranges and sorted in place; the counts of partitions, one number each, give every partition's offset.
    The dealt rows are checkpointed, so both passes see the same partitions even if executors are lost.
    """
    from ..sources.shared import checkpointed

    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def assign_batches(rows: DataFrame, batch_size: int, order: tuple[str, ...], drop_last: bool = True) -> DataFrame:
    """rows with batch_id; the incomplete last batch is dropped on request."""
    ranked = global_rank(rows, *order)
    out = ranked.withColumn("batch_id", F.floor((F.col("rank") - 1) / batch_size))
    if drop_last:
        total = ranked.agg(F.count("*").alias("_total"))
        out = out.crossJoin(total).where(F.col("batch_id") < F.floor(F.col("_total") / batch_size)).drop("_total")
    return out.drop("rank")


def run_name(model: str = "model_type", started: str = "started"):
    return F.concat_ws("__", F.col(model), F.date_format(started, "dd-MM-yy-HH-mm-ss"))


def run_catalog(runs: DataFrame, name: str = "run_id") -> DataFrame:
    """(run_id, model_type, started) from names model__dd-MM-yy-HH-mm-ss; a name of another form gives nulls."""
    parts = F.split(F.col(name), "__")
    good = F.col(name).rlike(r"^.+__\d\d-\d\d-\d\d-\d\d-\d\d-\d\d$")
    return runs.select(F.col(name).alias("run_id"), F.when(good, parts[0]).alias("model_type"), F.try_to_timestamp(F.when(good, F.get(parts, 1)), F.lit("dd-MM-yy-HH-mm-ss")).alias("started"))
