"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's target is its share of `share` times all words, by weight, held at most at `most` times the source's own
words; what is cut off goes to the others by weight. Blocks of equally many words are given to sources by the highest
quotients target / (2 * blocks so far + 1). As this order of blocks never takes one back, shard k's integer quota is what
the first k shards get less what the first k - 1 get. A source's documents are laid end to end in seeded order and cut into
blocks; shard 1 takes its quota of blocks from a seeded one on, each further shard goes on where the one before it ended, round
and round, so a document is taken at most `most` times and `dealt` says which of its words go to which shard.

Defined results: a null or empty text has 0 words and is never taken; a null source is a source of its own, last; a source
without words has target 0; rows that repeat a doc_id, or have none, are laid out each on its own, and the mix follows each
row's own plan; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import textops as X
from .tables import cut

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 1024
#: The smallest positive target holds at least this many blocks, so rounding to blocks stays below half a percent.
LEAST_BLOCKS = 200
SHARDS = 16


@F.arrow_udf(LongType())
def n_words(texts: pa.Array) -> pa.Array:
    sizes = np.zeros(len(texts), np.int64)
    for row, end, data, offsets in X.pieces(texts):
        sizes[row:end] = np.bincount(X.word_spans(data, offsets)[2], minlength=end - row)
    return pa.array(sizes)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target), one row per source, from rows (source, size)."""
    everything = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    names = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    # sources reach their cap in order of cap / weight; the level is what is left per weight of those not capped
    filled = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = names.withColumn("cap", most * F.col("source_size")).withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    settled = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), F.coalesce(settled, F.lit(float("inf"))) * F.col("weight"))
    return capped.select("source", "source_size", "weight", target.alias("target"))


def shard_quotas(targets: DataFrame, shards: int = SHARDS, block: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(source, source_size, target, block, shard, blocks): quotas of whole blocks; blocks counts this and all earlier shards.

    With C sources and divisors T / (N - C/2) and T / (N + C/2), rounding gives at most and at least N blocks, so only the
    at most 2 C quotients between the two are ranked.
    """
    all_rows = Window.partitionBy(F.lit(1))
    small = F.min(F.when(F.col("target") > 0, F.col("target"))).over(all_rows)
    sized = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(small / least_blocks)))).withColumn("sum", F.sum("target").over(all_rows)).withColumn("c", F.count("*").over(all_rows))
    each = sized.select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")).withColumn("seats", F.floor(F.col("sum") * F.col("shard") / shards / F.coalesce("block", F.lit(1)) + 1e-9))
    low = F.when(F.col("seats") > F.col("c") / 2, F.floor(F.col("target") * (F.col("seats") - F.col("c") / 2) / F.col("sum") + 0.5)).otherwise(F.lit(0))
    high = F.floor(F.col("target") * (F.col("seats") + F.col("c") / 2 + 1) / F.col("sum") + 0.5)
    bounds = each.withColumn("low", F.when(F.col("sum") > 0, low).otherwise(F.lit(0)).cast("long")).withColumn("high", F.when(F.col("sum") > 0, high).otherwise(F.lit(0)).cast("long"))
    by_quotient = Window.partitionBy("shard").orderBy(F.desc("quotient"), F.col("source").isNull(), "source")
    extra = bounds.withColumn("spare", F.col("seats") - F.sum("low").over(Window.partitionBy("shard"))).select("*", F.explode_outer(F.when(F.col("high") > F.col("low"), F.sequence("low", F.col("high") - 1))).alias("seat"))
    ranked = extra.withColumn("quotient", F.when(F.col("seat").isNotNull(), F.col("target") / (2 * F.col("seat") + 1))).withColumn("won", (F.col("seat").isNotNull() & (F.row_number().over(by_quotient) <= F.col("spare"))).cast("long"))
    return ranked.groupBy("source", "source_size", "target", "block", "shard").agg((F.first("low") + F.sum("won")).alias("blocks"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: int = MOST, shards: int = SHARDS, block: int = BLOCK_WORDS, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, pieces, taken, dealt) of every row, and docs' column `row` where it is given.

    whole: times the document is taken from end to end; pieces: array of (first word, words) taken besides, from 0; dealt: the
    same words as (shard, copy, first, words), by shard.
    Place and bin follow the text too, so rows of one id, or of none, spread over the bins.
    """
    carried = [F.col(row)] if row else []
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash"), *carried).withColumn("place", F.xxhash64("doc_id", "text_hash", F.lit(seed))), "sizes")
    bins = max(1, int(sized.count() ** 0.5))
    sized = sized.withColumn("bin", F.pmod("place", F.lit(bins)))
    per_bin = sized.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    begins = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_bin = cut(per_bin.select("source", "bin", begins.alias("begins")), "bins")
    quotas = shard_quotas(source_targets(sized.select("source", "size"), weights, share, most), shards, block)
    first_block = F.pmod(F.xxhash64(F.coalesce("source", F.lit("\0")), F.lit(seed)), F.greatest(F.lit(1), F.floor(F.col("source_size") / F.col("block"))))
    quotas = cut(quotas.groupBy("source", "source_size", "target", "block").agg(F.max("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("each")).withColumn("take", F.least(F.col("blocks") * F.col("block"), most * F.col("source_size"))).withColumn("origin", F.coalesce(first_block * F.col("block"), F.lit(0))).withColumn("ends", F.transform("each", lambda e: F.least(e["blocks"] * F.col("block"), F.col("take")))).drop("each"), "quotas")
    own = Window.partitionBy("source", "bin").orderBy("place", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    x, q, b = laid.alias("x"), quotas.alias("q"), per_bin.alias("b")
    joined = x.join(b, F.col("x.source").eqNullSafe(F.col("b.source")) & (F.col("x.bin") == F.col("b.bin"))).join(q, F.col("x.source").eqNullSafe(F.col("q.source")))
    at, size, total = F.col("begins") + F.col("inside"), F.col("size"), F.col("source_size")
    rest = F.when(total > 0, F.col("take") - F.floor(F.col("take") / total) * total).otherwise(F.lit(0)).cast("long")
    one = joined.select(*([f"x.{row}"] if row else []), "x.doc_id", "x.source", "x.size", "source_size", "target", F.when(size > 0, F.floor(F.col("take") / total)).otherwise(F.lit(0)).cast("long").alias("whole"), at.alias("at"), F.col("origin").alias("lo"), (F.col("origin") + rest).alias("hi"), "ends")

    def overlap(lo, hi):
        start = F.greatest(F.lit(0), lo - F.col("at"))
        return F.struct(start.cast("long").alias("first"), (F.least(F.col("size"), hi - F.col("at")) - start).cast("long").alias("words"))

    pieces = F.filter(F.array(overlap(F.lit(0), F.col("hi") - F.col("source_size")), overlap(F.col("lo"), F.least(F.col("hi"), F.col("source_size")))), lambda p: p["words"] > 0)
    def share(k: Column, copy: int) -> Column:
        """What shard k, from 1, takes of the document as it comes in round `copy` over its source."""
        here = F.col("at") + copy * F.col("source_size")
        start = F.greatest(here, F.col("lo") + F.when(k > 1, F.get("ends", k - 2)).otherwise(F.lit(0)))
        end = F.least(here + F.col("size"), F.col("lo") + F.get("ends", k - 1))
        return F.struct(k.alias("shard"), F.lit(copy).alias("copy"), (start - here).cast("long").alias("first"), (end - start).cast("long").alias("words"))

    rounds = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ends")), lambda k: F.array(*[share(k, j) for j in range(most + 1)])))
    done = one.withColumn("pieces", pieces).withColumn("dealt", F.when(F.col("size") > 0, F.filter(rounds, lambda p: p["words"] > 0)).otherwise(F.filter(rounds, lambda p: F.lit(False))))
    taken = F.col("whole") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return done.select("doc_id", "source", "size", "source_size", "target", "whole", "pieces", taken.alias("taken"), "dealt", *carried)


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with docs' columns: a row for each time a document is taken, the last one cut to the words taken.

    doc_id, text and source are docs' columns of these names; n_chars, where there is one, follows a cut text. Rows are written
    with a number first, by which each finds its own plan.
    """
    columns = docs.columns
    rows = cut(docs.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    plan = mixed(rows.select("doc.doc_id", "doc.text", "doc.source", "row"), row="row", **options).where("taken > 0").select("row", "size", "whole", "pieces")
    partial = F.when(F.size("pieces") > 0, F.array(F.col("pieces"))).otherwise(F.array().cast("array<array<struct<first:bigint,words:bigint>>>"))
    entire = F.array_repeat(F.expr("cast(null as array<struct<first:bigint,words:bigint>>)"), F.col("whole").cast("int"))
    laid = rows.join(plan, "row").select("doc", "size", F.explode(F.concat(entire, partial)).alias("part"))
    words = F.expr(r"regexp_extract_all(doc.text, '[^\\x20\\x09-\\x0D]+', 0)")
    all_of_it = F.col("part").isNull() | (F.aggregate("part", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("size"))
    cut_text = F.concat_ws(" ", F.flatten(F.transform("part", lambda p: F.slice(words, p["first"].cast("int") + 1, p["words"].cast("int")))))
    made = {"text": F.when(all_of_it, F.col("doc.text")).otherwise(cut_text)}
    if "n_chars" in columns:
        made["n_chars"] = F.when(all_of_it, F.col("doc.n_chars")).otherwise(F.length(cut_text))
    return laid.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def op3_source_mixing(docs: DataFrame) -> DataFrame:
    """As the contract has it; shards lists shard:words of each shard that takes words of the document."""
    per_shard = F.transform(F.array_distinct(F.transform("dealt", lambda p: p["shard"])), lambda k: F.concat_ws(":", k.cast("string"), F.aggregate(F.filter("dealt", lambda p: p["shard"] == k), F.lit(0).cast("long"), lambda a, p: a + p["words"]).cast("string")))
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_join(per_shard, ",").alias("shards"))
