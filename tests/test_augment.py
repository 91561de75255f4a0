import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import augment as G
from framewright.operators import pixels as P


def draw(seed, sample, name, k):
    return int(hashlib.md5(f"{seed}:{sample}:{name}:{k}".encode()).hexdigest()[:8], 16) / 2**32


def test_draws_are_columns(spark):
    rows = spark.createDataFrame([(7, ["rotate", "hflip", "affine"]), (8, [])], "sample_id long, plan array<string>")
    got = {r.sample_id: r.d for r in rows.select("sample_id", G.planned_draws(3).alias("d")).collect()}
    assert got == {7: [[draw(3, 7, "rotate", 0)], [], [draw(3, 7, "affine", k) for k in range(6)]], 8: []}


def gaussian(field, sigma):
    """Means of a field by its definition, one pixel after another."""
    reach = max(1, int(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    mirror = lambda i, n: (j := i % (2 * n)) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    h, x = field.shape
    return np.array([[sum(w[a] * w[b] * field[mirror(i + a - reach, h), mirror(j + b - reach, x)] for a in range(len(w)) for b in range(len(w))) for j in range(x)] for i in range(h)])


def test_elastic_against_brute_force():
    rng = np.random.default_rng(1)
    image, d = rng.random((1, 9, 7, 2)), np.array([[0.37]])
    field = G.noise(d[:, 0], (2, 9, 7))
    assert field.shape == (1, 2, 9, 7) and abs(field).max() < 1
    dy, dx = (G.ALPHA * gaussian(field[0, k], G.SIGMA) for k in range(2))
    out = G.apply_all("elastic", image, d)[0]

    def at(y, x):
        y, x = (abs(v) % (2 * (n - 1)) for v, n in ((y, 9), (x, 7)))
        y, x = (2 * (n - 1) - v if v > n - 1 else v for v, n in ((y, 9), (x, 7)))
        a, b = int(y), int(x)
        c, e = min(a + 1, 8), min(b + 1, 6)
        return (image[0, a, b] * (b + 1 - x) + image[0, a, e] * (x - b)) * (a + 1 - y) + (image[0, c, b] * (b + 1 - x) + image[0, c, e] * (x - b)) * (y - a)

    want = np.array([[at(i + dy[i, j], j + dx[i, j]) for j in range(7)] for i in range(9)])
    assert np.allclose(out, want)


def test_noise_is_even():
    field = G.noise(np.arange(20) / 20, (100, 50))
    assert abs(field.mean()) < 0.01 and abs(field.std() - 3**-0.5) < 0.01 and len(np.unique(field)) == field.size


def test_a_batch_equals_its_images():
    rng = np.random.default_rng(2)
    for h, w in ((40, 33), (20, 20), (1, 5)):
        images = rng.random((5, h, w, 3))
        for name, n in G.DRAWS.items():
            draws = rng.random((5, n))
            whole = G.apply_all(name, images, draws)
            assert np.isfinite(whole).all()
            for i in range(5):
                assert np.array_equal(whole[i], G.apply_all(name, images[i : i + 1], draws[i : i + 1])[0]), name


def test_planned_images_of_many_sizes(spark):
    rng, rows = np.random.default_rng(3), []
    names = [n for _, n, _, _ in G.CATALOGUE]
    for i in range(60):
        h, w = [(20, 20), (18, 25), (25, 18)][i % 3]
        plan = [n for n in names if rng.random() < 0.4]
        rows.append((i, h, w, None if i == 13 else rng.random(h * w * 3).tolist(), None if i == 14 else plan, "kept"))
    df = spark.createDataFrame(rows, "sample_id long, height int, width int, data array<double>, plan array<string>, extra string")
    got = {r.sample_id: r for r in G.apply_plan(df.repartition(3), 9).collect()}
    for i, h, w, data, plan, _ in rows:
        r = got[i]
        if data is None or plan is None:
            assert (r.height, r.width, r.data) == (h, w, data) and r.extra == "kept"
            continue
        image = np.array(data).reshape(1, h, w, 3)
        for name in plan:
            image = G.apply_all(name, image, np.array([[draw(9, i, name, k) for k in range(G.DRAWS[name])]]))
        assert (r.height, r.width) == image.shape[1:3] and np.allclose(r.data, image.ravel())
    assert G.apply_plan(df.limit(0), 9).count() == 0


def test_resize_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(i, h, w, None if i == 5 else rng.random(h * w * 2).tolist()) for i, (h, w) in enumerate([(4, 6), (9, 3), (4, 6), (1, 1), (30, 7), (2, 2)] * 3)]
    rows = [(i, *r[1:3], None if i == 5 else r[3]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, height int, width int, data array<double>")
    for kind in ("bilinear", "triangular"):
        got = {r.id: r for r in P.resize(df, 5, kind, channels=2).collect()}
        for i, h, w, data in rows:
            if data is None:
                assert (got[i].height, got[i].data) == (h, None)
                continue
            want = np.einsum("yh,xw,hwc->yxc", P.resize_weights(h, 5, kind), P.resize_weights(w, 5, kind), np.array(data).reshape(h, w, 2))
            assert (got[i].height, got[i].width) == (5, 5) and np.allclose(got[i].data, want.ravel())
    with pytest.raises(ValueError):
        P.resize_weights(3, 2, "cubic")


def test_floats_stay_floats(spark):
    df = spark.range(3).select(F.col("id").alias("sample_id"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.array(*[F.lit(v).cast("float") for v in (0.0, 0.25, 0.5, 1.0)]).alias("data"), F.array(F.lit("hflip")).alias("plan"))
    out = G.apply_plan(df, 1, channels=1)
    assert dict(out.dtypes)["data"] == "array<float>" and out.first().data == [0.25, 0.0, 1.0, 0.5]


def test_large_images_are_made_in_many_tasks(spark, tmp_path):
    """A table in one partition: its images are enlarged in three tasks a core, and a line's sum is right; a vector that is null has black pixels."""
    from framewright.plans import queries as Q

    rows = [(i, [((i * 37 + k * 11) % 100) / 100 - 0.5 for k in range(64)], i % 3) for i in range(20)] + [(20, None, 0), (21, [0.25], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    large = Q._large(spark, f"file://{tmp_path}", "dropout")
    assert large.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    got = {(x.sample_id, x.y): x.total for x in Q._lines(large).collect()}
    assert len(got) == 22 * 32
    for i, v, _ in rows:
        image = np.zeros(64)
        image[: len(v or [])] = [int((np.float32(x).astype(float) + 1) * 127.5) / 255 for x in v or []]
        image = image.reshape(8, 8).repeat(4, 0).repeat(4, 1)
        assert all(abs(got[i, y] - (image[y] * np.arange(1, 33)).sum()) < 1e-4 for y in range(32))


def test_enlarged_images_of_any_size(spark):
    rows = [(1, 2, 3, [float(i) for i in range(12)]), (2, 1, 1, [7.0, 8.0]), (3, 1, 1, None)]
    images = spark.createDataFrame(rows, "sample_id long, height int, width int, data array<double>").coalesce(1)
    got = {x.sample_id: x for x in P.enlarge(images, 2, channels=2).collect()}
    want = np.arange(12.0).reshape(2, 3, 2).repeat(2, 0).repeat(2, 1)
    assert (got[1].height, got[1].width, got[1].data) == (4, 6, want.ravel().tolist())
    assert got[2].data == [7.0, 8.0] * 4 and got[3].data is None
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [5.0, 6.0])], "i int, data array<double>").coalesce(1)
    assert {x.i: x.s for x in one.select("i", P.line_sums(F.col("data"), 2).alias("s")).collect()} == {1: [5.0, 11.0], 2: None, 3: [17.0]}
