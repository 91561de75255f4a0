"""Reading inputs and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Ids (8 bytes each) that a join may send to every executor, and bytes of rows of any width; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
BROADCAST_BYTES = 64 << 20
#: Bytes that a row takes in a broadcast table besides its columns.
ROW_BYTES = 24


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that all executors share."""
    return f"{shared_folder(spark)}/framewright-{spark.sparkContext.applicationId}"


#: Bytes of an Arrow batch; Spark's own 64 MB of texts take some hundred MB in each Python worker and executor.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_BYTES from now on, unless the session names a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, f"{ARROW_BYTES}b")


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that `cut` writes inside are removed at the end, except those taken out of the list."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.pop()
        for df in made:
            discard(df)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages survive lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that `cut` has written and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_bytes(rows: DataFrame) -> int:
    """Bytes of a row of numbers and digests in a broadcast table; other columns have no bound."""
    widths = {"string": 40, "binary": 24}
    if odd := [c for c, t in rows.dtypes if t not in widths and not re.fullmatch("(tiny|small|big)?int|float|double|boolean", t)]:
        raise ValueError(f"no bound on the size of {', '.join(odd)}")
    return ROW_BYTES + sum(widths.get(t, 8) for _, t in rows.dtypes)


def sent_if_few(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """rows (a few numbers or digests each, already written), to be broadcast where they are at most `most` and BROADCAST_BYTES."""
    return F.broadcast(rows) if rows.count() <= min(most, BROADCAST_BYTES // row_bytes(rows)) else rows


#: A key of a join that many rows share is spread over so many tasks.
SALTS = 64


def spread_join(many: DataFrame, one: DataFrame, key: str, spread_by: str, right: str | None = None, how: str = "inner") -> DataFrame:
    """many joined with one on key (in one: `right`, of distinct values), where many rows may hold the same key.

    Rows of one key are dealt over SALTS tasks by a hash of another column, and what `one` has for the key goes to those of
    the tasks that have rows, so at most SALTS times.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    kept = one.select(*[F.col(c).alias(f"_{c}" if c == (right or key) else c) for c in one.columns])
    name = f"_{right or key}"
    wanted = salted.select(key, "_salt").distinct().join(kept, F.col(key) == F.col(name)).select(name, F.col("_salt").alias("_salt_"), *[c for c in kept.columns if c != name])
    joined = salted.join(wanted, (F.col(key) == F.col(name)) & (F.col("_salt") == F.col("_salt_")), how).drop("_salt", "_salt_")
    return joined.withColumnRenamed(name, right) if right and right != key else joined.drop(name)
