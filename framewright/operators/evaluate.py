"""Confusion matrices and metrics on scores (label, pred) and logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .losses import cross_entropy_row, ignore_label
from .ranks import running_sums


def confusion_matrix(scores: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, pred, n), dense; classes has (label), one row per class."""
    counts = ignore_label(scores).groupBy("label", "pred").agg(F.count("*").alias("n"))
    grid = classes.select("label").crossJoin(classes.select(F.col("label").alias("pred")))
    return grid.join(counts, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_percent(matrix: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("label"))
    return matrix.withColumn("percent", F.col("n") / (total + 1e-6) * 100)


def class_outcomes(matrix: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) of every class."""
    hit = F.col("label") == F.col("pred")
    rows = matrix.groupBy("label").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fn"))
    cols = matrix.groupBy(F.col("pred").alias("label")).agg(F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fp"))
    return rows.join(cols, "label").select("label", "tp", "fp", "fn")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _per_class(name: str) -> Column:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {"Accuracy": _share(tp, tp + fn), "Precision": _share(tp, tp + fp), "Recall": _share(tp, tp + fn), "F1": _share(2 * tp, 2 * tp + fp + fn), "Jaccard": _share(tp, tp + fp + fn)}[name]


METRICS = ("Accuracy", "Precision", "Recall", "F1", "Jaccard", "AveragePrecision", "ConfusionMatrix")


def metrics(matrix: DataFrame, names: str = "Jaccard", binary: bool = False, positive: int = 1, scored: DataFrame | None = None) -> DataFrame:
    """One row, a column per metric named in a comma-separated list: macro over classes that occur, or of one class.

    AveragePrecision takes scored rows (class_id, score, positive 0/1). ConfusionMatrix is an array of (label, pred, n) by label
    and pred: one entry per pair of classes, whatever the number of rows.
    """
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    known = {m.lower(): m for m in METRICS}
    if unknown := [n for n in wanted if n.lower() not in known]:
        raise ValueError(f"unknown metrics {unknown}; known: {', '.join(METRICS)}")
    wanted = [known[n.lower()] for n in wanted]
    parts = []
    plain = [m for m in wanted if m not in ("AveragePrecision", "ConfusionMatrix")]
    if binary and "Accuracy" in plain:
        parts.append(matrix.agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("Accuracy")))
    own = [m for m in plain if not (binary and m == "Accuracy")]
    if own and binary:
        parts.append(class_outcomes(matrix).where(F.col("label") == positive).select(*[_per_class(m).alias(m) for m in own]))
    elif own:
        parts.append(class_outcomes(matrix).where(F.col("tp") + F.col("fp") + F.col("fn") > 0).agg(*[F.avg(_per_class(m)).alias(m) for m in own]))
    if "AveragePrecision" in wanted:
        if scored is None:
            raise ValueError("AveragePrecision needs scored rows (class_id, score, positive)")
        of = average_precision(scored)
        parts.append((of.where(F.col("class_id") == positive) if binary else of).agg(F.avg("ap").alias("AveragePrecision")))
    if "ConfusionMatrix" in wanted:
        parts.append(matrix.agg(F.array_sort(F.collect_list(F.struct("label", "pred", "n"))).alias("ConfusionMatrix")))
    out, *others = parts
    for other in others:  # one row each
        out = out.crossJoin(other)
    return out.select(*wanted)


def average_precision(scored: DataFrame) -> DataFrame:
    """(class_id, ap) from rows (class_id, score, positive 0/1): sum of recall steps times precision over distinct scores."""
    steps = scored.groupBy("class_id", "score").agg(F.count("*").alias("n"), F.sum("positive").alias("p"))
    totals = steps.groupBy("class_id").agg(F.sum("p").alias("total"))
    run = running_sums(steps, "class_id", [F.desc("score")], seen=F.col("n"), hits=F.col("p")).join(totals, "class_id")
    return run.where("total > 0").groupBy("class_id").agg(F.sum(F.col("p") / F.col("total") * F.col("hits") / F.col("seen")).alias("ap"))


def average_test_loss(scores: DataFrame) -> DataFrame:
    return ignore_label(scores).agg(F.avg(cross_entropy_row(F.col("logits"), F.col("label"))).alias("loss"))
