"""Augmentation: a plan of the transforms that fire for each sample, and the transforms.

Planning is native: a sample meets the fixed catalogue and keeps what its seeded draw allows, and the parameters of its transforms
are drawn as columns. Tasks apply a transform to all images of one size in an Arrow batch at once. Augmentation is always an explicit call; scoring never augments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pixels import arrays_of, with_images

#: Transforms in their order, share of the base probability, and whether only rare classes get them.
CATALOGUE = [
    (0, "hflip", 0.5, False),
    (1, "vflip", 0.5, False),
    (2, "transpose", 0.3, False),
    (3, "rotate", 0.4, False),
    (4, "affine", 0.4, False),
    (5, "brightness_contrast", 0.4, False),
    (6, "gamma", 0.3, False),
    (7, "grid_distortion", 0.2, False),
    (8, "dropout", 1.0, True),
    (9, "elastic", 1.0, True),
    (10, "shadow", 1.0, True),
]


def base_probability(p_scale: Column) -> Column:
    return F.least(F.greatest(F.bround(0.7 * p_scale, 4), F.lit(0.0)), F.lit(1.0))


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "place int, transform string, share double, rare boolean")


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def planned_transforms(samples: DataFrame, seed: int) -> DataFrame:
    """(sample_id, place, transform) for each transform that fires; samples have p_scale."""
    met = samples.crossJoin(F.broadcast(catalogue(samples.sparkSession))).where(~F.col("rare") | (F.col("p_scale") > 1.0))
    fires = unit_draw(F.lit(seed), F.col("sample_id"), F.col("transform")) < F.col("share") * base_probability(F.col("p_scale"))
    return met.where(fires).select("sample_id", "place", "transform")


def augmentation_plan(samples: DataFrame, seed: int) -> DataFrame:
    """samples with plan: the transforms that fire, in order."""
    rows = planned_transforms(samples, seed).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("place", "transform"))).alias("p"))
    return samples.join(rows.select("sample_id", F.transform("p", lambda x: x["transform"]).alias("plan")), "sample_id", "left").withColumn("plan", F.coalesce("plan", F.array().cast("array<string>")))


#: Draws in [0, 1) that a transform takes its parameters from.
DRAWS = {"hflip": 0, "vflip": 0, "transpose": 0, "rotate": 1, "affine": 6, "brightness_contrast": 2, "gamma": 1, "grid_distortion": 10, "dropout": 17, "elastic": 1, "shadow": 10}
HOLES, HOLE = 4, (16, 32)
STEPS, ALPHA, SIGMA = 5, 50.0, 5.0


def draws_of(transform: Column, sample: Column, seed: int) -> Column:
    """The draws of a transform for a sample: md5 of seed:sample:transform:number."""
    n = F.element_at(F.create_map(*[x for k, v in DRAWS.items() for x in (F.lit(k), F.lit(v))]), transform)
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: unit_draw(F.lit(seed), sample, transform, k))


def planned_draws(seed: int) -> Column:
    """For each transform of plan its draws."""
    return F.transform("plan", lambda t: draws_of(t, F.col("sample_id"), seed))


def reflect(at: np.ndarray, n: int) -> np.ndarray:
    """Positions mirrored at the edges, which are not repeated."""
    if n == 1:
        return np.zeros_like(at)
    period = 2.0 * (n - 1)
    at = np.mod(np.abs(at), period)
    return np.where(at > n - 1, period - at, at)


def remap(images: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples of images (n, h, w, c) at positions y, x (n, h, w) with mirrored borders."""
    n, h, w = images.shape[:3]
    y, x = reflect(y, h), reflect(x, w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    which = np.arange(n)[:, None, None]
    top = images[which, y0, x0] * (1 - fx) + images[which, y0, x1] * fx
    return top * (1 - fy) + (images[which, y1, x0] * (1 - fx) + images[which, y1, x1] * fx) * fy


def warp_all(images: np.ndarray, scale: np.ndarray, degrees: np.ndarray, shift: np.ndarray, shear: np.ndarray) -> np.ndarray:
    """Inverse warps about the centre, one a row: scale, shear and rotation in degrees, shift in pixels (x, y)."""
    n, h, w = images.shape[:3]
    a, tan = np.deg2rad(degrees), np.tan(np.deg2rad(shear))
    one = np.ones(n)
    turn = np.stack([np.cos(a), -np.sin(a), np.sin(a), np.cos(a)], -1).reshape(n, 2, 2)
    slant = np.stack([one, tan[:, 0], tan[:, 1], one], -1).reshape(n, 2, 2)
    back = np.linalg.inv(turn @ slant * scale[:, None, None])
    x, y = np.meshgrid(np.arange(w) - (w - 1) / 2, np.arange(h) - (h - 1) / 2)
    grid = np.stack([x[None] - shift[:, 0, None, None], y[None] - shift[:, 1, None, None]], 1)
    at = np.einsum("nij,njyx->niyx", back, grid)
    return remap(images, at[:, 1] + (h - 1) / 2, at[:, 0] + (w - 1) / 2)


def warp(image: np.ndarray, scale: float = 1.0, degrees: float = 0.0, shift=(0.0, 0.0), shear=(0.0, 0.0)) -> np.ndarray:
    """warp_all of one image (h, w, c)."""
    return warp_all(image[None], np.array([scale]), np.array([degrees]), np.array([shift]), np.array([shear]))[0]


def noise(draws: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """(n, *shape) values in [-1, 1), one row for each draw: mixed 64-bit counters, the same in every task."""
    start = (draws * 2.0**53).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = start[:, None] + np.arange(1, int(np.prod(shape)) + 1, dtype=np.uint64)[None] * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float).reshape(len(draws), *shape) / 2.0**52 - 1


def smooth(fields: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean over the last two axes, edges mirrored with the edge repeated; a sum of shifted arrays, not a loop over rows."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (-2, -1):
        n, at = fields.shape[axis], np.arange(-reach, fields.shape[axis] + reach)
        at = np.mod(at, 2 * n)
        padded = np.take(fields, np.where(at < n, at, 2 * n - 1 - at), axis)
        fields = sum(k * np.take(padded, np.arange(i, i + n), axis) for i, k in enumerate(kernel))
    return fields


def grid_axis(draws: np.ndarray, n: int) -> np.ndarray:
    """Where each of n places is taken from when STEPS cells between fixed ends are stretched by up to 0.3."""
    knots = np.concatenate([np.zeros((len(draws), 1)), np.cumsum(1 + 0.6 * draws - 0.3, 1)], 1)
    knots *= (n - 1) / knots[:, -1:]
    at = np.arange(n) * (STEPS / max(1, n - 1))
    cell = np.minimum(at.astype(int), STEPS - 1)
    return knots[:, cell] + (knots[:, cell + 1] - knots[:, cell]) * (at - cell)


def holes(draws: np.ndarray, h: int, w: int) -> np.ndarray:
    """(n, HOLES, 4): top, bottom, left, right of each hole; an unused one is empty."""
    count = 1 + np.floor(draws[:, 0] * HOLES)
    u = draws[:, 1:].reshape(-1, HOLES, 4)
    tall, wide = (np.minimum(HOLE[0] + np.floor(u[..., i] * (HOLE[1] - HOLE[0] + 1)), size) for i, size in ((0, h), (1, w)))
    top, left = np.floor(u[..., 2] * (h - tall + 1)), np.floor(u[..., 3] * (w - wide + 1))
    used = np.arange(HOLES)[None] < count[:, None]
    return np.stack([top, top + tall * used, left, left + wide * used], -1)


def shadow_mask(draws: np.ndarray, h: int, w: int) -> np.ndarray:
    """(n, h, w): pixels whose centre lies in a polygon of five corners in the lower half, put in order of angle about their mean."""
    corners = np.stack([draws[:, :5] * w, h / 2 + draws[:, 5:] * (h / 2)], -1)
    away = corners - corners.mean(1, keepdims=True)
    order = np.argsort(np.arctan2(away[..., 1], away[..., 0]), 1)
    corners = np.take_along_axis(corners, order[..., None], 1)
    y, x = np.meshgrid(np.arange(h) + 0.5, np.arange(w) + 0.5, indexing="ij")
    inside = np.zeros((len(draws), h, w), bool)
    for i in range(5):
        (x0, y0), (x1, y1) = (corners[:, k].T[..., None, None] for k in (i, (i + 1) % 5))
        crosses = (y0 > y) != (y1 > y)
        inside ^= crosses & (x < (x1 - x0) * (y - y0) / np.where(y1 == y0, 1e-12, y1 - y0) + x0)
    return inside


def apply_all(name: str, images: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """One transform of images (n, h, w, c) of one size in the unit range; draws (n, DRAWS[name])."""
    n, h, w = images.shape[:3]
    none = np.zeros((n, 2))
    if name == "hflip":
        return images[:, :, ::-1]
    if name == "vflip":
        return images[:, ::-1]
    if name == "transpose":
        return images.transpose(0, 2, 1, 3)
    if name == "rotate":
        return warp_all(images, np.ones(n), 40 * draws[:, 0] - 20, none, none)
    if name == "affine":
        shift = (0.1 * draws[:, 2:4] - 0.05) * (w, h)
        return warp_all(images, 0.9 + 0.2 * draws[:, 0], 30 * draws[:, 1] - 15, shift, 20 * draws[:, 4:6] - 10)
    if name == "brightness_contrast":
        gain, bias = (0.3 * draws - 0.15).T[..., None, None, None]
        return np.clip(images * (1 + gain) + bias, 0, 1)
    if name == "gamma":
        return np.power(np.clip(images, 0, 1), (0.8 + 0.4 * draws)[..., None, None])
    if name == "grid_distortion":
        y, x = grid_axis(draws[:, :5], h), grid_axis(draws[:, 5:], w)
        return remap(images, *(np.broadcast_to(v, (n, h, w)) for v in (y[:, :, None], x[:, None, :])))
    if name == "elastic":
        moved = ALPHA * smooth(noise(draws[:, 0], (2, h, w)), SIGMA)
        return remap(images, np.arange(h)[None, :, None] + moved[:, 0], np.arange(w)[None, None] + moved[:, 1])
    if name == "dropout":
        y, x = np.arange(h)[None, None, :, None], np.arange(w)[None, None, None]
        top, bottom, left, right = np.moveaxis(holes(draws, h, w), -1, 0)[..., None, None]
        gone = ((y >= top) & (y < bottom) & (x >= left) & (x < right)).any(1)
        return np.where(gone[..., None], 0.0, images)
    if name == "shadow":
        return np.where(shadow_mask(draws, h, w)[..., None], images * 0.5, images)
    raise ValueError(f"unknown transform {name}")


def apply_one(name: str, image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One transform of one image (h, w, c), its draws from rng."""
    return apply_all(name, image[None], rng.random((1, DRAWS.get(name, 0))))[0]


def apply_plan(planned: DataFrame, seed: int, channels: int = 3) -> DataFrame:
    """planned (sample_id, height, width, data, plan, ...) with the planned transforms applied to data, height and width.

    Parameters are drawn by Spark; a task applies each transform of the catalogue, in its order, to all images of one size in
    its batch at once. Rows with null data, or an empty plan, stay as they are.
    """
    drawn = planned.withColumn("_draws", planned_draws(seed))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, plans, draws = arrays_of(batch, channels), batch.column("plan").to_pylist(), batch.column("_draws").to_pylist()
            for _, name, _, _ in CATALOGUE:
                groups: dict[tuple, list[int]] = {}
                for i, plan in enumerate(plans):
                    if images[i] is not None and name in (plan or ()):
                        groups.setdefault(images[i].shape, []).append(i)
                for rows in groups.values():
                    own = np.array([draws[i][plans[i].index(name)] for i in rows]).reshape(len(rows), DRAWS[name])
                    for i, image in zip(rows, apply_all(name, np.stack([images[i] for i in rows]), own), strict=True):
                        images[i] = image
            yield with_images(batch, images, [c for c in batch.schema.names if c != "_draws"])

    return drawn.mapInArrow(work, planned.schema)


def finish(images: DataFrame, size: int, channels: int = 3) -> DataFrame:
    """images (height, width, data, mean, std, ...) resized, normalised and laid out as CHW."""
    from .pixels import normalize, resize, to_chw

    done = resize(images, size, "bilinear", channels)
    return done.withColumn("data", to_chw(normalize(F.col("data"), F.col("mean"), F.col("std"), channels), F.lit(size), F.lit(size), channels))


def augment(samples: DataFrame, seed: int, size: int, channels: int = 3) -> DataFrame:
    """Planned, transformed, resized, normalised and laid out as CHW; samples have p_scale, mean and std."""
    return finish(apply_plan(augmentation_plan(samples, seed), seed, channels), size, channels)
