"""The first k rows of an order by hash, without sorting all rows or bringing k of them together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import group_rank

#: Hex digits that one pass looks at; a pass counts at most 16 ** DIGITS groups.
DIGITS = 4
#: Rows at the cut that are ranked; more of them are told apart by their next digits first.
BORDER = 100_000


def smallest(rows: DataFrame, k: int, drawn: str, *order: str, border: int = BORDER) -> DataFrame:
    """The k rows that come first by drawn (hex digits, as from md5), then by order.

    A pass counts rows by their next digits and finds the group in which the k-th row lies, until that group is small or ends
    with the k-th row. Rows of lower groups stay by a filter; only the last group is ranked. So a pass shuffles a count for each group and
    task, and no more than the rows of one group change place, whatever k is.

    Defined results: k of 0 or less gives no row, k above the number of rows gives all; a null in drawn comes first; rows equal in drawn
    and order are taken from in any order.
    """
    if k <= 0:
        return rows.limit(0)
    digits = F.coalesce(F.col(drawn), F.lit(""))
    prefix, need, size = "", k, None
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    while size is None or size > border:
        here = rows.where(digits.startswith(prefix)) if prefix else rows
        counts = here.groupBy(F.substring(digits, len(prefix) + 1, DIGITS).alias("part")).agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        at = before.where((F.col("before") < need) & (F.col("before") + F.col("n") >= need)).first()
        if at is None:
            return rows
        prefix, need, size = prefix + at.part, need - at.before, at.n
        if need == size or not at.part:
            break
    head = F.substring(digits, 1, len(prefix))
    if need == size:
        return rows.where(head <= prefix)
    last = group_rank(rows.where(head == prefix).withColumn("_one", F.lit(1)), "_one", drawn, *order, name="_rank")
    return rows.where(head < prefix).unionByName(last.where(F.col("_rank") <= need).drop("_one", "_rank"))
