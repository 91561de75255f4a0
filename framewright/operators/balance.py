"""Class balance: rarity factors, weights and margins. All work on one row per class (class_name, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def median_class_size(counts: DataFrame) -> DataFrame:
    return counts.agg(F.median("n").alias("median"))


def repeat_factor(counts: DataFrame) -> DataFrame:
    """counts with factor: ceil(2 * median / n) held between 1 and 10; 1 for an empty class."""
    rarity = F.ceil(F.col("median") / F.col("n") * 2)
    factor = F.when(F.col("n") == 0, F.lit(1)).otherwise(F.least(F.greatest(rarity, F.lit(1)), F.lit(10)))
    return counts.crossJoin(median_class_size(counts)).withColumn("factor", factor.cast("long")).drop("median")


def p_scale(factors: DataFrame) -> DataFrame:
    """factors with p_scale: 0.5 + factor / largest, at most 2, rounded half-even to 2 digits."""
    most = factors.agg(F.max("factor").alias("most"))
    return factors.crossJoin(most).withColumn("p_scale", F.bround(F.least(F.lit(2.0), 0.5 + F.col("factor") / F.col("most")), 2)).drop("most")


def balanced_weights(counts: DataFrame) -> DataFrame:
    """counts with weight N / (C * n); null for an empty class."""
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.crossJoin(total).withColumn("weight", F.try_divide("total", F.col("classes") * F.col("n"))).drop("total", "classes")


def effective_number_weights(counts: DataFrame, beta: float) -> DataFrame:
    """counts with weight (1 - beta) / (1 - beta^n), scaled to sum to the number of classes; null for an empty class."""
    if beta == 0:
        return counts.withColumn("weight", F.when(F.col("n") > 0, F.lit(1.0)))
    raw = counts.withColumn("raw", F.try_divide(F.lit(1 - beta), 1 - F.pow(F.lit(beta), F.col("n"))))
    total = raw.agg(F.sum("raw").alias("total"), F.count("*").alias("classes"))
    return raw.crossJoin(total).withColumn("weight", F.col("raw") / F.col("total") * F.col("classes")).drop("raw", "total", "classes")


def drw_weights(counts: DataFrame, epochs: DataFrame, start: int = 160, betas: tuple[float, float] = (0.0, 0.9999)) -> DataFrame:
    """(epoch, class_name, n, weight): the first beta before epoch `start`, the second from it on."""
    early, late = (epochs.where(c).crossJoin(effective_number_weights(counts, b)) for c, b in ((F.col("epoch") < start, betas[0]), (F.col("epoch") >= start, betas[1])))
    return early.unionByName(late)


def ldam_margins(counts: DataFrame, max_m: float = 0.5) -> DataFrame:
    """counts with margin n^(-1/4), scaled so that the largest is max_m; null for an empty class."""
    raw = counts.withColumn("raw", F.when(F.col("n") > 0, F.pow("n", F.lit(-0.25))))
    return raw.crossJoin(raw.agg(F.max("raw").alias("most"))).withColumn("margin", F.col("raw") * max_m / F.col("most")).drop("raw", "most")


def oversample(split: DataFrame, factors: DataFrame, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Each row of the named splits `factor` times; copy counts from 1."""
    from .manifest import attach_factor

    rows = attach_factor(split, factors)
    times = F.when(F.col("split").isin(*splits), F.col("factor")).otherwise(F.lit(1))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("factor")
