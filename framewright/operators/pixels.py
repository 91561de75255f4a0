"""Pixel operations on flat arrays (row-major, channel last unless said) and channel statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind


def _gather(data: Column, source) -> Column:
    """The value at source(i) for every place i."""
    return bind(data, lambda d: F.transform(d, lambda _, i: F.get(d, source(i).cast("int"))))


def gray_to_rgb(data: Column) -> Column:
    """Each value three times."""
    return F.flatten(F.transform(data, lambda v: F.array(v, v, v)))


def reorder_channels(data: Column, order: tuple[int, ...] = (2, 1, 0)) -> Column:
    """Channels of every pixel in another order; the default turns BGR into RGB and back."""
    c, picks = len(order), F.array(*map(F.lit, order))
    return _gather(data, lambda i: i - i % c + F.get(picks, i % c))


def to_rgb(data: Column, channels: Column) -> Column:
    """RGB of a decoded image of 1 (gray), 3 (BGR) or 4 (BGRA) channels."""

    def four(d: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(d) / 4).cast("int") - 1), lambda p: F.array(*[F.get(d, p * 4 + k) for k in (2, 1, 0)])))

    return bind(data, lambda d: F.when(channels == 1, gray_to_rgb(d)).when(channels == 4, four(d)).otherwise(reorder_channels(d)))


def to_chw(data: Column, height: Column, width: Column, channels: int = 3) -> Column:
    size = height * width
    return _gather(data, lambda i: (i % size) * channels + F.floor(i / size))


def to_hwc(data: Column, height: Column, width: Column, channels: int = 3) -> Column:
    size = height * width
    return _gather(data, lambda i: (i % channels) * size + F.floor(i / channels))


def scale_unit(data: Column, dtype: Column) -> Column:
    """uint8 divided by 255; other types as they are."""
    return F.when(dtype == "uint8", F.transform(data, lambda v: v.cast("double") / 255)).otherwise(F.transform(data, lambda v: v.cast("double")))


def normalize(data: Column, mean: Column, std: Column, channels: int = 3) -> Column:
    both = F.struct(mean.alias("mean"), std.alias("std"))
    return bind(both, lambda s: F.transform(data, lambda v, i: (v - F.get(s["mean"], (i % channels).cast("int"))) / F.get(s["std"], (i % channels).cast("int"))))


def explode_pixels(images: DataFrame, data: str = "data", channels: int = 3, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """(keys, pixel, channel, value): for small data."""
    return images.select(*keys, F.posexplode(data).alias("i", "value")).select(*keys, F.expr(f"i div {channels}").alias("pixel"), (F.col("i") % channels).alias("channel"), "value")


def hflip(data: Column, width: Column, channels: int) -> Column:
    def source(i: Column) -> Column:
        pixel = F.floor(i / channels)
        return (pixel - pixel % width + width - 1 - pixel % width) * channels + i % channels

    return _gather(data, source)


def vflip(data: Column, height: Column, width: Column, channels: int) -> Column:
    row = width * channels
    return _gather(data, lambda i: (height - 1 - F.floor(i / row)) * row + i % row)


def transpose(data: Column, height: Column, width: Column, channels: int) -> Column:
    """Rows become columns; the result is width x height."""

    def source(i: Column) -> Column:
        pixel = F.floor(i / channels)
        return ((pixel % height) * width + F.floor(pixel / height)) * channels + i % channels

    return _gather(data, source)


def brightness_contrast(data: Column, alpha: Column, beta: Column) -> Column:
    """alpha * x + beta, held in the unit range."""
    return F.transform(data, lambda v: F.least(F.greatest(alpha * v + beta, F.lit(0.0)), F.lit(1.0)))


def gamma(data: Column, power: Column) -> Column:
    return F.transform(data, lambda v: F.pow(v, power))


def channel_moments(data: Column, channels: int = 3) -> Column:
    """array of (channel, n, mean, m2) of one image, by numpy on Arrow batches: one pass, whatever the image's size."""

    @F.arrow_udf("array<struct<channel:int,n:bigint,mean:double,m2:double>>")
    def moments(images: pa.Array) -> pa.Array:
        values, out = np.asarray(images.flatten(), float), []
        ends = np.cumsum(np.asarray(images.value_lengths().fill_null(0), np.int64))
        for a, b, known in zip(np.concatenate([[0], ends[:-1]]), ends, images.is_valid().to_pylist(), strict=True):
            parts = [values[a:b][c::channels] for c in range(channels)]
            out.append([{"channel": c, "n": len(v), "mean": v.mean(), "m2": ((v - v.mean()) ** 2).sum()} for c, v in enumerate(parts) if len(v)] if known else None)
        return pa.array(out, pa.list_(pa.struct([("channel", pa.int32()), ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64())])))

    return moments(data)


def channel_stats(images: DataFrame, data: str = "data", channels: int = 3, ddof: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, channel, mean, std) over every pixel: only one row per image and channel reaches the shuffle.

    Moments merge as mean = sum(n m) / sum(n) and M2 = sum(M2) + sum(n m^2) - (sum(n m))^2 / sum(n), centred on 0.5 of
    the unit range to keep the difference small. std is 0 for a single pixel.
    """
    shift = 0.5
    # no filter on data: moments leave null and empty images out, and a filter would work out, and decode, each image a second time
    parts = images.select(*by, F.explode(channel_moments(F.col(data), channels)).alias("m")).select(*by, "m.*")
    x = F.col("mean") - shift
    sums = parts.groupBy(*by, "channel").agg(F.sum("n").alias("n"), F.sum(F.col("n") * x).alias("s"), F.sum(F.col("n") * x * x).alias("q"), F.sum("m2").alias("m2"))
    m2 = F.greatest(F.lit(0.0), F.col("m2") + F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    std = F.when(F.col("n") > ddof, F.sqrt(m2 / (F.col("n") - ddof))).otherwise(F.lit(0.0))
    return sums.select(*by, "channel", (F.col("s") / F.col("n") + shift).alias("mean"), std.alias("std"))


def class_channel_stats(images: DataFrame, data: str = "data", channels: int = 3, ddof: int = 1) -> DataFrame:
    return channel_stats(images, data, channels, ddof, ("class_name",))


def stats_table(stats: DataFrame, key: str = "class_name") -> DataFrame:
    """(class_name, mean, std) as arrays by channel; a handful of rows per class."""

    def ordered(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("channel", name))), lambda x: x[name]).alias(name)

    return stats.groupBy(key).agg(ordered("mean"), ordered("std"))


def default_stats(spark) -> DataFrame:
    return spark.createDataFrame([("default", [0.5] * 3, [0.5] * 3)], "class_name string, mean array<double>, std array<double>")


def attach_stats(samples: DataFrame, stats: DataFrame, by: str = "class", fallback: float = 0.5, channels: int = 3) -> DataFrame:
    """samples with mean and std: those of the class (by="class") or of `default` for all (by="global").

    Statistics of a sample's own class tell its label, so scoring takes by="global". Without a default row, fallback is it.
    """
    rest = stats.where("class_name = 'default'").agg(F.first("mean").alias("mean_"), F.first("std").alias("std_"))
    constant = F.array(*[F.lit(fallback)] * channels)
    rest = rest.select(F.coalesce("mean_", constant).alias("mean_"), F.coalesce("std_", constant).alias("std_"))
    own = stats.where("class_name <> 'default'") if by == "class" else stats.where("1 = 0")
    joined = samples.join(own.select("class_name", "mean", "std"), "class_name", "left").crossJoin(rest)
    return joined.withColumn("mean", F.coalesce("mean", "mean_")).withColumn("std", F.coalesce("std", "std_")).drop("mean_", "std_")


def resize_weights(source: int, target: int, kind: str) -> np.ndarray:
    """target x source weights. bilinear: half-pixel centres; triangular: the same filter widened when shrinking."""
    scale = source / target
    centre = (np.arange(target) + 0.5) * scale - 0.5
    if kind == "bilinear":
        low = np.floor(np.clip(centre, 0, None)).astype(int)
        share = np.clip(centre, 0, None) - low
        out = np.zeros((target, source))
        rows = np.arange(target)
        np.add.at(out, (rows, np.minimum(low, source - 1)), 1 - share)
        np.add.at(out, (rows, np.minimum(low + 1, source - 1)), share)
        return out
    if kind != "triangular":
        raise ValueError(f"unknown filter {kind}")
    width = max(1.0, scale)
    out = np.clip(1 - np.abs(np.arange(source)[None] - centre[:, None]) / width, 0, None)
    return out / out.sum(1, keepdims=True)


def arrays_of(batch: pa.RecordBatch, channels: int) -> list[np.ndarray | None]:
    """The images (h, w, c) of a batch (height, width, data channel last), without copies where Arrow allows."""
    data = batch.column("data")
    values, ends = np.asarray(data.flatten(), float), np.cumsum(np.asarray(data.value_lengths().fill_null(0), np.int64))
    sizes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), data.is_valid().to_pylist(), ends, strict=True)
    return [values[end - h * w * channels : end].reshape(h, w, channels) if known else None for h, w, known, end in sizes]


def with_images(batch: pa.RecordBatch, images: list[np.ndarray | None], names: list[str]) -> pa.RecordBatch:
    """The named columns of batch, with height, width and data of these images; a null image keeps its height and width."""
    ends = np.cumsum([0] + [0 if x is None else x.size for x in images])
    flat = np.concatenate([x.ravel() for x in images if x is not None] or [np.zeros(0)])
    none = pa.array([x is None for x in images], pa.bool_())
    columns = {c: batch.column(c) for c in names}
    kind = batch.schema.field("data").type
    columns["data"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind.value_type), mask=none).cast(kind)
    for i, c in enumerate(("height", "width")):
        before = columns[c].to_pylist()
        columns[c] = pa.array([b if x is None else x.shape[i] for b, x in zip(before, images, strict=True)], columns[c].type)
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def enlarge(images: DataFrame, times: int, channels: int = 3) -> DataFrame:
    """images (..., height, width, data channel-last) with every pixel times as high and wide; a null image stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            large = [None if x is None else x.repeat(times, 0).repeat(times, 1) for x in arrays_of(batch, channels)]
            yield with_images(batch, large, batch.schema.names)

    return images.mapInArrow(work, images.schema)


def line_sums(data: Column, width: int) -> Column:
    """array of one sum for each line of an image of one channel: its values, each times its place in the line, counted from 1."""

    @F.arrow_udf("array<double>")
    def sums(images: pa.Array) -> pa.Array:
        lines = np.asarray(images.flatten(), float).reshape(-1, width) @ np.arange(1.0, width + 1)
        ends = np.cumsum(np.concatenate([[0], np.asarray(images.value_lengths().fill_null(0), np.int64) // width]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lines), mask=images.is_null())

    return sums(data)


def resize(images: DataFrame, size: int, kind: str = "bilinear", channels: int = 3) -> DataFrame:
    """images (..., height, width, data channel-last) at size x size.

    Weights are made once per source size and task; all images of one size in an Arrow batch are resized by two matrix products.
    Rows with null data stay as they are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            found = arrays_of(batch, channels)
            groups: dict[tuple, list[int]] = {}
            for i, x in enumerate(found):
                if x is not None:
                    groups.setdefault(x.shape, []).append(i)
            for (h, w, c), rows in groups.items():
                for n in (h, w):
                    if n not in made:
                        made[n] = resize_weights(n, size, kind)
                tall = made[h] @ np.stack([found[i] for i in rows]).reshape(len(rows), h, w * c)
                for i, x in zip(rows, made[w] @ tall.reshape(len(rows), size, w, c), strict=True):
                    found[i] = x
            yield with_images(batch, found, batch.schema.names)

    return images.mapInArrow(work, images.schema)
