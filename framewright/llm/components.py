"""Connected components of a table of links, by alternating large and small stars in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, spread_join


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node that can be reached.

    Each round only sends a node's smallest neighbour about; no neighbour list is ever gathered. Rounds grow with the
    logarithm of the longest chain. Every round is written to the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(small, "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("m").alias("component")), F.struct(F.col("m").alias("node"), F.col("m").alias("component")))).alias("e")).select("e.*").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)
