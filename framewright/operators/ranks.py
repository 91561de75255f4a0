"""Running sums and ranks inside groups, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def running_sums(rows: DataFrame, by: str, order: list, **sums: Column) -> DataFrame:
    """rows with columns named in sums: each sum over the rows of the same group up to this one, in that order.

    Rows are dealt by ranges of (group, order), so a large group lies in many partitions; what earlier partitions hold of a
    group, one row a partition and group, is added to the sums inside a partition. The dealt rows are checkpointed, so
    both passes see the same partitions even if executors are lost.
    """
    added = rows.withColumns({f"_add_{k}": v for k, v in sums.items()})
    dealt = checkpointed(added.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    per = dealt.groupBy("_part", by).agg(*[F.sum(f"_add_{k}").alias(k) for k in sums])
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(F.col("_part").alias("_of"), F.col(by).alias("_by"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums])
    inside = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_add_{k}": F.sum(f"_add_{k}").over(inside) for k in sums})
    joined = summed.join(before, (F.col("_part") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(*rows.columns, *[(F.col(f"_before_{k}") + F.col(f"_add_{k}")).alias(k) for k in sums])


def group_rank(rows: DataFrame, by: str, *order: str | Column, name: str = "rank") -> DataFrame:
    """rows with the 1-based position in their group."""
    return running_sums(rows, by, list(order), **{name: F.lit(1)})
