"""Manifest of samples: class index, positions, counts and look-ups of small class tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import group_rank


def class_index(manifest: DataFrame) -> DataFrame:
    """(class_name, class_idx): 0-based rank by name. Only the distinct names meet in one window."""
    names = manifest.select("class_name").distinct()
    return names.select("class_name", (F.row_number().over(Window.orderBy("class_name")) - 1).alias("class_idx"))


def with_class_index(manifest: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    classes = class_index(manifest) if classes is None else classes
    return manifest.join(classes.select("class_name", "class_idx"), "class_name")


def sample_index(manifest: DataFrame, order: str = "path") -> DataFrame:
    """manifest with sample_idx: 0-based position in its class."""
    return group_rank(manifest, "class_name", order, name="sample_idx").withColumn("sample_idx", F.col("sample_idx") - 1)


def class_counts(manifest: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(class_name, n); with a list of classes, those without files count 0."""
    counts = manifest.groupBy("class_name").agg(F.count("*").alias("n"))
    if classes is None:
        return counts
    return classes.select("class_name").join(counts, "class_name", "left").select("class_name", F.coalesce("n", F.lit(0)).alias("n"))


def class_distribution(split: DataFrame, classes: DataFrame, stage: str = "split") -> DataFrame:
    """(stage, split, class_idx, class_name, n)."""
    counts = split.groupBy("split", "class_name").agg(F.count("*").alias("n"))
    return attach(counts, classes, "class_name", ["class_idx"]).select(F.lit(stage).alias("stage"), "split", "class_idx", "class_name", "n")


def drop_tiny_classes(manifest: DataFrame, least: int = 3) -> DataFrame:
    """Rows of classes with at least `least` rows; the counts, one row per class, are joined back."""
    big = class_counts(manifest).where(F.col("n") >= least).select("class_name")
    return manifest.join(big, "class_name", "left_semi")


def flatten_label(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("label", F.col("class_idx"))


def attach(rows: DataFrame, small: DataFrame, key: str, columns: list[str], defaults: dict | None = None) -> DataFrame:
    """Look columns up in a table of one row per key; a missing key gives the default, or null."""
    joined = rows.join(small.select(key, *columns), key, "left")
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def resolve_split(split: DataFrame, manifest: DataFrame, on_missing: str = "drop") -> DataFrame:
    """Paths and labels of (class_idx, sample_idx); on_missing="report" gives the rows without a file instead."""
    keys = ["class_idx", "sample_idx"]
    if on_missing == "report":
        return split.join(manifest, keys, "left_anti")
    return split.join(manifest, keys)


def used_classes(manifest: DataFrame, split: DataFrame) -> DataFrame:
    return manifest.join(split.select("class_idx").distinct(), "class_idx", "left_semi")


def attach_factor(samples: DataFrame, factors: DataFrame, default: int = 1) -> DataFrame:
    return attach(samples, factors, "class_name", ["factor"], {"factor": default})


def attach_p_scale(samples: DataFrame, p_scale: DataFrame, default: float = 0.8) -> DataFrame:
    return attach(samples, p_scale, "class_name", ["p_scale"], {"p_scale": default})


def attach_class_name(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return attach(rows, classes, "class_idx", ["class_name"])
