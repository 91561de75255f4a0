"""Reproducible shuffles, samples and the stratified split. Order comes from md5, so no partitioning changes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import group_rank
from .selection import smallest


def draw(seed: object, id_: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")))


def shuffle_rank(rows: DataFrame, seed: object, by: str, id_: str = "sample_id", name: str = "rank") -> DataFrame:
    """rows with the 1-based position in a seeded shuffle of each group."""
    drawn = rows.withColumn("_draw", draw(seed, id_))
    return group_rank(drawn, by, "_draw", id_, name=name).drop("_draw")


def seeded_sample(rows: DataFrame, k: int, seed: object, id_: str = "sample_id") -> DataFrame:
    """The first k rows of a seeded shuffle of all rows; see `smallest`."""
    return smallest(rows.withColumn("_draw", draw(seed, id_)), k, "_draw", id_).drop("_draw")


def sorted_scan(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*columns)


def _parts(rank: Column, n: Column, n_test: Column, n_val: Column) -> Column:
    """train, then val, then test along the class shuffle; classes of three give one row each."""
    train = F.when(n == 3, F.lit(1)).otherwise(n - n_test - n_val)
    val = F.when(n == 3, F.lit(1)).otherwise(n_val)
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def union_splits(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def stratified_split(samples: DataFrame, factors: DataFrame, val_split: float = 0.7, max_total: int = 3200, seed: int = 42, rare: int = 6) -> DataFrame:
    """(sample_id, class_name, split).

    Classes under 3 rows are left out; those of 3 give one row to each part; rare ones (factor >= rare) give
    max(1, round(0.3 n)) rows to test and to val. The others share a pool, cut to max_total less the train and val rows
    given so far, and each splits what survives: a fifth to test, 1 - val_split of the rest to val. Rounding is
    half-even. Windows see ids and hashes only, and the room for the pool comes from the class sizes, before any split.
    """
    counted = samples.select("sample_id", "class_name").join(factors.select("class_name", "n", "factor"), "class_name").where("n >= 3")
    forced = (F.col("n") == 3) | (F.col("factor") >= rare)
    first = shuffle_rank(counted.where(forced), f"{seed}:forced", "class_name")
    k = F.greatest(F.lit(1), F.bround(F.lit(0.3) * F.col("n"))).cast("long")
    fixed = first.select("sample_id", "class_name", _parts(F.col("rank"), F.col("n"), k, k).alias("split"))
    pool = counted.where(~forced).select("sample_id", "class_name")
    given = F.when(F.col("n") == 3, F.lit(2)).otherwise(F.col("n") - k)
    left = max_total - (factors.where((F.col("n") >= 3) & forced).agg(F.sum(given)).first()[0] or 0)
    pool = seeded_sample(pool, left, f"{seed}:cut")
    sizes = pool.groupBy("class_name").agg(F.count("*").alias("m")).where("m >= 3")
    second = shuffle_rank(pool.join(sizes, "class_name"), f"{seed}:common", "class_name")
    n_test = F.greatest(F.lit(1), F.bround(F.lit(0.2) * F.col("m"))).cast("long")
    n_val = F.greatest(F.lit(1), F.bround(F.lit(1 - val_split) * (F.col("m") - n_test))).cast("long")
    common = second.select("sample_id", "class_name", _parts(F.col("rank"), F.col("m"), n_test, n_val).alias("split"))
    return union_splits(fixed, common)
