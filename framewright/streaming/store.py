"""Results of a streaming query that outlive its runs: one Parquet version per batch, the last whole one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class ResultStore:
    """Versions of a table under a folder that the driver and all executors share, by any path that Spark can open.

    Parquet's committer leaves `_SUCCESS` in a version when all its files are there, so a version without it is an attempt that was
    cut short, and is not read. A batch that is repeated after a failure writes its own version again; versions of later
    batches than the one that is written belong to a query whose state is gone, and go too.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def versions(self) -> list[int]:
        """Batches whose version is whole, oldest first."""
        found = self._files().globStatus(self._path("batch-*", "_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch-")) for f in found)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder}/batch-{batch}")
        whole = self.versions()
        for old in [v for v in whole if v > batch] + [v for v in whole if v <= batch][: -self.keep]:
            self._files().delete(self._path(f"batch-{old}"), True)

    def latest(self, schema: StructType) -> DataFrame | None:
        whole = self.versions()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/batch-{whole[-1]}") if whole else None
