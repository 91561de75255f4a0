"""Losses on scores (sample_id, label, logits array<double>), with per-row columns and their reductions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind

IGNORED = -100


def log_sum_exp(logits: Column) -> Column:
    """Stable: the largest logit is subtracted first."""

    def above(l: Column, most: Column) -> Column:
        return most + F.log(F.aggregate(l, F.lit(0.0), lambda a, v: a + F.exp(v - most)))

    return bind(logits, lambda l: bind(F.array_max(l), lambda most: above(l, most)))


def softmax(logits: Column) -> Column:
    return bind(logits, lambda l: bind(log_sum_exp(l), lambda total: F.transform(l, lambda v: F.exp(v - total))))


def argmax_class(logits: Column) -> Column:
    """Index of the largest logit, the first on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def cross_entropy_row(logits: Column, label: Column) -> Column:
    return bind(logits, lambda l: log_sum_exp(l) - F.get(l, label))


def ignore_label(rows: DataFrame, label: int = IGNORED) -> DataFrame:
    return rows.where(F.col("label") != label)


def attach_class_weight(scores: DataFrame, weights: DataFrame, columns: tuple[str, ...] = ("weight",)) -> DataFrame:
    """scores with columns of weights (label, ...)."""
    return scores.join(weights.select("label", *columns), "label", "left")


def _weight(scores: DataFrame) -> Column:
    return F.col("weight") if "weight" in scores.columns else F.lit(1.0)


def cross_entropy(scores: DataFrame) -> DataFrame:
    """One row: the mean; with a weight column, sum(w l) / sum(w)."""
    rows = ignore_label(scores)
    return rows.agg((F.sum(_weight(rows) * cross_entropy_row(F.col("logits"), F.col("label"))) / F.sum(_weight(rows))).alias("loss"))


def focal_loss(scores: DataFrame, gamma: float = 2.0) -> DataFrame:
    """One row: the plain mean of (1 - exp(-l))^gamma l, where l is the weighted cross entropy."""
    rows = ignore_label(scores)
    rows = rows.withColumn("_l", _weight(rows) * cross_entropy_row(F.col("logits"), F.col("label")))
    return rows.agg(F.avg(F.pow(1 - F.exp(-F.col("_l")), F.lit(gamma)) * F.col("_l")).alias("loss"))


def ldam_loss(scores: DataFrame, s: float = 30.0) -> DataFrame:
    """One row; scores have a margin column: the true logit less the margin, all times s, then cross entropy."""
    lowered = F.transform("logits", lambda v, i: (v - F.when(i == F.col("label"), F.col("margin")).otherwise(F.lit(0.0))) * s)
    return cross_entropy(ignore_label(scores).withColumn("logits", lowered))


LOSSES: dict[str, Callable[..., DataFrame]] = {"CrossEntropyLoss": cross_entropy, "FocalLoss": focal_loss, "LDAMLoss": ldam_loss}
#: Settings that steer training and are no argument of a loss.
CONTROL = ("ignore_background", "weights", "start_epoch", "betas")


def loss(scores: DataFrame, name: str, **params) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name}; known: {', '.join(LOSSES)}")
    return LOSSES[name](scores, **{k: v for k, v in params.items() if k not in CONTROL})
