"""Tensors as NPY shards: a data source whose tasks write float32 CHW arrays in [0, 1] that numpy or a trainer can map into memory.

A table of tensors is a folder with an index and shards. A shard is one NPY array (n, channels, height, width) of images of one size,
and a Parquet file with the other columns of its rows, in the same order. The index lists the shards with their shape, rows and the
least and greatest value of each plain column; a job's shards count from the moment the index names them. Paths are any that
pyarrow can open (file, s3, gs, hdfs); driver and executors must see the same folder.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

INDEX = "_tensors.json"
#: Bytes of tensors that a shard holds at least before it is written; a task keeps so many in memory, and a batch more.
SHARD_BYTES = 64 << 20
#: Bytes of tensors in one partition of a read, and in one batch.
PART_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
SHAPE = ("channels", "height", "width")


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file://" + "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def _read_index(files: fs.FileSystem, folder: str) -> dict | None:
    if files.get_file_info(f"{folder}/{INDEX}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{folder}/{INDEX}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]
    skipped: int


def to_unit_chw(values: np.ndarray, layout: str, dtype: str, height: int, width: int, channels: int) -> np.ndarray:
    """(n, channels, height, width) float32 in [0, 1] from n flat images; uint8 values are divided by 255, others held in range."""
    n = len(values)
    image = values.reshape(n, channels, height, width) if layout == "CHW" else values.reshape(n, height, width, channels).transpose(0, 3, 1, 2)
    image = image / 255 if dtype == "uint8" else image
    return np.ascontiguousarray(np.clip(image, 0, 1), np.float32)


def _plain(value: object) -> object:
    return value.isoformat() if isinstance(value, date | datetime) else value


class TensorWriter(DataSourceArrowWriter):
    """Each task writes shards to a folder of the job; commit moves them into place and names them in the index."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, shard_bytes: int):
        if "image" not in schema.names:
            raise ValueError("tensors are written from a column named image")
        if taken := {*SHAPE, "tensor"} & set(schema.names):
            raise ValueError(f"columns of these names are made here: {', '.join(sorted(taken))}")
        self.path, self.overwrite, self.shard_bytes, self.job = path, overwrite, shard_bytes, uuid.uuid4().hex
        self.keys = json.loads(StructType([f for f in schema.fields if f.name != "image"]).json())

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        files, folder = open_folder(self.path)
        return files, folder, f"{folder}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, staging = self._staging()
        files.create_dir(staging, recursive=True)
        task = TaskContext.get()
        name = f"{self.job[:8]}-{task.partitionId():05d}-{task.attemptNumber()}"
        shelves: dict[tuple, list] = {}
        out, skipped, held = [], 0, 0

        def flush(shape: tuple) -> None:
            nonlocal held
            tensors, keys = shelves.pop(shape)
            array, table = np.concatenate(tensors), pa.Table.from_batches(keys)
            shard = f"{name}-{len(out):04d}"
            # the pieces go out one after another: the header needs their number, not their values
            with files.open_output_stream(f"{staging}/{shard}.npy") as f:
                head = io.BytesIO()
                np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": array.shape})
                f.write(head.getvalue())
                f.write(memoryview(array).cast("B"))
            with files.open_output_stream(f"{staging}/{shard}.parquet") as f:
                pq.write_table(table, f)
            span = {}
            for c in table.column_names:
                if pa.types.is_primitive(table[c].type) or pa.types.is_string(table[c].type):
                    least = pc.min_max(table[c])
                    span[c] = [_plain(least["min"].as_py()), _plain(least["max"].as_py()), table[c].null_count]
            out.append({"name": shard, "rows": len(array), "shape": list(shape), "bytes": array.nbytes, "range": span})
            held -= array.nbytes

        for batch in iterator:
            image = batch.column("image")
            keys = batch.select([c for c in batch.schema.names if c != "image"]) if self.keys["fields"] else pa.RecordBatch.from_arrays([pa.nulls(len(batch))], ["_none"])
            fields = [image.field(n).to_pylist() for n in ("nChannels", "height", "width", "layout", "dtype")]
            data, good = image.field("data"), image.is_valid().to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, kind in enumerate(zip(*fields, strict=True)):
                if good[i] and data[i].is_valid:
                    groups.setdefault(kind, []).append(i)
                else:
                    skipped += 1
            for (c, h, w, layout, dtype), rows in groups.items():
                own = data.take(pa.array(rows, pa.int64()))
                if set(own.value_lengths().to_pylist()) != {c * h * w}:
                    raise ValueError(f"an image of {c} x {h} x {w} has another number of values")
                made = to_unit_chw(np.asarray(own.flatten(), float).reshape(len(rows), -1), layout, dtype, h, w, c)
                shelf = shelves.setdefault((c, h, w), [[], []])
                shelf[0].append(made)
                shelf[1].append(keys.take(pa.array(rows, pa.int64())))
                held += made.nbytes
            while held >= self.shard_bytes:
                flush(max(shelves, key=lambda s: sum(x.nbytes for x in shelves[s][0])))
        for shape in list(shelves):
            flush(shape)
        return Written(out, skipped)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder, staging = self._staging()
        before = _read_index(files, folder)
        if before and not self.overwrite and before["keys"] != self.keys:
            raise ValueError(f"{self.path} holds tensors with other columns")
        done = [m for m in messages if m is not None]
        shards = [s for m in done for s in m.shards]
        for s in shards:
            for kind in ("npy", "parquet"):
                files.move(f"{staging}/{s['name']}.{kind}", f"{folder}/{s['name']}.{kind}")
        kept = before["shards"] if before and not self.overwrite else []
        index = {"dtype": "float32", "layout": "CHW", "keys": self.keys, "shards": kept + shards, "skipped": sum(m.skipped for m in done) + (before["skipped"] if kept else 0)}
        with files.open_output_stream(f"{folder}/_index-{self.job}") as f:
            f.write(json.dumps(index).encode())
        files.move(f"{folder}/_index-{self.job}", f"{folder}/{INDEX}")
        for s in before["shards"] if before and self.overwrite else []:
            for kind in ("npy", "parquet"):
                files.delete_file(f"{folder}/{s['name']}.{kind}")
        self._clear(files, staging)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, staging = self._staging()
        self._clear(files, staging)

    @staticmethod
    def _clear(files: fs.FileSystem, staging: str) -> None:
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


@dataclass
class Slice(InputPartition):
    name: str
    shape: tuple[int, int, int]
    start: int
    stop: int


def may_hold(shard: dict, wanted: Filter) -> bool:
    """Could a row of this shard pass the filter? Only filters on one plain column with known bounds say no."""
    name = ".".join(getattr(wanted, "attribute", ()))
    spans = dict(zip(SHAPE, [[n, n, 0] for n in shard["shape"]], strict=True)) | shard["range"]
    if name not in spans:
        return True
    low, high, nulls = spans[name]
    values = [_plain(v) for v in (wanted.value if isinstance(wanted, In) else [getattr(wanted, "value", None)])]
    if low is None:
        return not isinstance(wanted, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)
    if any(v is not None and type(v) is not type(low) for v in values):
        return True
    if isinstance(wanted, EqualNullSafe) and values == [None]:
        return nulls > 0
    if isinstance(wanted, EqualTo | EqualNullSafe | In):
        return any(v is not None and low <= v <= high for v in values)
    tests = {GreaterThan: lambda v: high > v, GreaterThanOrEqual: lambda v: high >= v, LessThan: lambda v: low < v, LessThanOrEqual: lambda v: low <= v}
    return tests[type(wanted)](values[0]) if type(wanted) in tests and values[0] is not None else True


class TensorReader(DataSourceReader):
    """Partitions of bounded size over the shards that filters leave; only the columns of the schema are read."""

    def __init__(self, path: str, schema: StructType, part_bytes: int):
        self.path, self.names, self.part_bytes, self.filters = path, schema.names, part_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.filters = list(filters)
        yield from filters

    def partitions(self) -> list[Slice]:
        files, folder = open_folder(self.path)
        parts = []
        for s in _read_index(files, folder)["shards"]:
            if all(may_hold(s, f) for f in self.filters):
                step = max(1, self.part_bytes // max(1, s["bytes"] // s["rows"]))
                parts += [Slice(s["name"], tuple(s["shape"]), a, min(a + step, s["rows"])) for a in range(0, s["rows"], step)]
        self.filters = []
        return parts or [Slice("", (0, 0, 0), 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, folder = open_folder(self.path)
        own = [c for c in self.names if c not in (*SHAPE, "tensor")]
        with files.open_input_file(f"{folder}/{partition.name}.parquet") as f:
            keys = pq.read_table(f, columns=own).slice(partition.start, partition.stop - partition.start) if own else None
        size = int(np.prod(partition.shape))
        step = max(1, BATCH_BYTES // (4 * size)) if "tensor" in self.names else 1 << 16
        tensors = files.open_input_file(f"{folder}/{partition.name}.npy") if "tensor" in self.names else None
        try:
            if tensors is not None:
                np.lib.format.read_magic(tensors)
                np.lib.format.read_array_header_1_0(tensors)
                tensors.seek(tensors.tell() + 4 * size * partition.start)
            for at in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - at)
                columns = {c: pa.array(np.full(n, v, np.int32)) for c, v in zip(SHAPE, partition.shape, strict=True)}
                if tensors is not None:
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * size)
                    columns["tensor"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(tensors.read(4 * size * n), np.float32)))
                columns |= {c: keys[c].slice(at - partition.start, n).combine_chunks() for c in own}
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], self.names)
        finally:
            if tensors is not None:
                tensors.close()


class TensorSource(DataSource):
    """Options: path; columns (comma-separated, for reads of some columns); shard_bytes; part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> StructType:
        files, folder = open_folder(self.options["path"])
        index = _read_index(files, folder)
        if index is None:
            raise ValueError(f"no tensors at {self.options['path']}")
        whole = StructType.fromJson(index["keys"])
        for c in SHAPE:
            whole = whole.add(c, IntegerType())
        whole = whole.add("tensor", ArrayType(FloatType()))
        if chosen := self.options.get("columns"):
            whole = StructType([whole[c.strip()] for c in chosen.split(",")])
        return whole

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self.options["path"], schema, int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options["path"], schema, overwrite, int(self.options.get("shard_bytes", SHARD_BYTES)))


def image_struct(data: str | Column, height: str | Column, width: str | Column, channels: int = 3, layout: str = "HWC", dtype: str = "uint8") -> Column:
    """The struct that decode_images returns, from flat columns."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(col(height).cast("int").alias("height"), col(width).cast("int").alias("width"), F.lit(channels).alias("nChannels"), F.lit(layout).alias("layout"), F.lit(dtype).alias("dtype"), col(data).cast("array<double>").alias("data"))


def write_tensors(images: DataFrame, path: str, mode: str = "append", shard_bytes: int = SHARD_BYTES) -> None:
    """All images (image, other columns) as float32 CHW tensors in [0, 1], whatever their number and sizes.

    Rows with a null image are counted in the index and not written; an image whose values do not fit its shape fails
    the job, which then leaves nothing. mode is append or overwrite.
    """
    images.sparkSession.dataSource.register(TensorSource)
    images.write.format("tensors").mode(mode).option("shard_bytes", shard_bytes).save(path)


def read_tensors(spark: SparkSession, path: str, *columns: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(other columns, channels, height, width, tensor) of all rows, or some of these columns."""
    spark.dataSource.register(TensorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("tensors").option("part_bytes", part_bytes)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)
