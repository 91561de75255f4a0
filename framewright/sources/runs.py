"""A training run's saved lists, read back for scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import attach_p_scale, resolve_split, sample_index, with_class_index
from ..operators.pixels import attach_stats
from .io import read_data_stats, read_p_scale, read_split_index, scan_images, write_data_stats, write_p_scale, write_split_index


def save_run(split: DataFrame, classes: DataFrame, stats: DataFrame, root: str, run_id: str) -> None:
    """What a run leaves under root/run_id: split lists (split, class_idx, sample_idx), class table (class_name, p_scale), statistics."""
    write_split_index(split, f"{root}/{run_id}/lists")
    write_p_scale(classes.withColumn("run_id", F.lit(run_id)), root)
    write_data_stats(stats, f"{root}/{run_id}/data_stats.json")


def scoring_samples(spark: SparkSession, images_root: str, root: str, run_id: str, split: str = "test", by: str = "global", glob: str = "*") -> DataFrame:
    """(path, class_name, class_idx, sample_idx, p_scale, mean, std) of the samples of a run's split, in one call.

    Classes and positions come from the image folder as it is now, as when the lists were written. Scoring takes the statistics of
    `default`, or 0.5 where the run has none, because those of a sample's own class tell its label; by="class" takes these.
    """
    files = scan_images(spark, images_root, glob)
    manifest = sample_index(with_class_index(files))
    found = resolve_split(read_split_index(spark, f"{root}/{run_id}/lists/split={split}"), manifest)
    scales = read_p_scale(spark, root, "classes.txt").where(F.col("run_id") == run_id)
    stats = read_data_stats(spark, f"{root}/{run_id}/data_stats.json")
    return attach_stats(attach_p_scale(found, scales), stats, by).select("path", "class_name", "class_idx", "sample_idx", "p_scale", "mean", "std")
