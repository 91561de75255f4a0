"""Files from rows: one file for each (path, content), written by tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from .tensors import open_folder


@dataclass
class Counted(WriterCommitMessage):
    files: int


class FileWriter(DataSourceArrowWriter):
    """A file appears whole, by a move, or not at all. A task that fails takes back what it wrote; a repeated one writes the same names."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Counted:
        files, root = open_folder(self.root)
        made, written = set(), []
        try:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    if not path or path.startswith("/") or ".." in path.split("/"):
                        raise ValueError(f"not a path below the root: {path}")
                    target = f"{root}/{path}"
                    folder, _, name = target.rpartition("/")
                    if folder not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    with files.open_output_stream(f"{folder}/_{name}.tmp") as f:
                        f.write(content.as_buffer() if content.is_valid else b"")
                    files.move(f"{folder}/_{name}.tmp", target)
                    written.append(target)
        except BaseException:
            for target in written:
                if files.get_file_info(target).type == fs.FileType.File:
                    files.delete_file(target)
            raise
        return Counted(len(written))

    def commit(self, messages: list[Counted | None]) -> None:
        pass

    def abort(self, messages: list[Counted | None]) -> None:
        pass


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file_a_row"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(rows: DataFrame, root: str) -> None:
    """The content of every row at root/path; a null content makes an empty file. Paths are distinct."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).write.format("one_file_a_row").mode("append").save(root)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


@F.arrow_udf(BinaryType())
def png(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
    out = []
    for h, w, c, row in zip(height.to_pylist(), width.to_pylist(), channels.to_pylist(), data, strict=True):
        pixels = np.asarray(row.values, float).round().clip(0, 255).astype(np.uint8).reshape(h, w * c)
        lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels], 1).tobytes()
        head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
        out.append(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b""))
    return pa.array(out, pa.binary())


def png_bytes(height: str | Column, width: str | Column, channels: str | Column, data: str | Column) -> Column:
    """An image (channel last, 0 to 255; 1, 3 or 4 channels) as a PNG file."""
    return png(height, width, channels, data)
