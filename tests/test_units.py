import json
import os

import numpy as np
import pytest
from framewright.functions.params import infer_param
from framewright.operators import augment as G
from framewright.operators import balance as B
from framewright.operators import evaluate as E
from framewright.operators import history as T
from framewright.operators import losses as L
from framewright.operators import manifest as M
from framewright.operators import pixels as P
from framewright.operators import split as S
from framewright.sources import io
from framewright.streaming import stats as ST
from pyspark.sql import functions as F

SIZES = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 15, "g": 40, "h": 200}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(1000 * i + j, name) for i, (name, n) in enumerate(SIZES.items()) for j in range(n)]
    return spark.createDataFrame(rows, "sample_id long, class_name string")


@pytest.fixture(scope="module")
def factors(samples):
    return B.repeat_factor(M.class_counts(samples))


@pytest.mark.parametrize("most", [10, 120, 3200])
def test_split_sizes(samples, factors, most):
    rows = S.stratified_split(samples, factors, max_total=most).collect()
    assert len({r.sample_id for r in rows}) == len(rows)
    n = {}
    for r in rows:
        n.setdefault(r.class_name, {}).setdefault(r.split, 0)
        n[r.class_name][r.split] += 1
    factor = {r.class_name: r.factor for r in factors.collect()}
    assert "a" not in n and "b" not in n and n["c"] == {"train": 1, "val": 1, "test": 1}
    for name, size in SIZES.items():
        if size > 3 and factor[name] >= 6:
            k = max(1, round(0.3 * size))
            assert n[name] == {"train": size - 2 * k, "val": k, "test": k}
        elif size > 3 and most == 3200:
            t = max(1, round(0.2 * size))
            v = max(1, round((1 - 0.7) * (size - t)))
            assert n[name] == {"train": size - t - v, "val": v, "test": t}
    again = S.stratified_split(samples.repartition(7), factors, max_total=most)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_p_scale_ties(spark):
    rows = [(str(f), 1, f) for f in (1, 3, 5, 7, 8)]
    got = {r.factor: r.p_scale for r in B.p_scale(spark.createDataFrame(rows, "class_name string, n long, factor long")).collect()}
    assert got == {1: 0.62, 3: 0.88, 5: 1.12, 7: 1.38, 8: 1.5}


def test_empty_class(spark):
    counts = spark.createDataFrame([("x", 0), ("y", 4), ("z", 16)], "class_name string, n long")
    for f, column in ((B.balanced_weights, "weight"), (lambda c: B.effective_number_weights(c, 0.9), "weight"), (B.ldam_margins, "margin")):
        got = {r.class_name: r[column] for r in f(counts).collect()}
        assert got["x"] is None and got["y"] > got["z"]
    assert {r.class_name: r.factor for r in B.repeat_factor(counts).collect()}["x"] == 1


VALUES = {"'512'": ("int", 512), "1e-5": ("float", 1e-5), "True": ("bool", True), "none": ("none", None), "leakyrelu": ("string", None), "[0.05, 0.08]": ("list", ["0.05", "0.08"]), "(1, 3)": ("list", ["1", "3"]), "Accuracy, ConfusionMatrix": ("string", None), '"quoted"': ("string", None), "50     ": ("int", 50), "small": ("string", None), "{'a': 1}": ("dict", None), "v1.5": ("string", None), "-3": ("int", -3), "2.": ("float", 2.0)}


def test_typed_parameters(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string").select("v", infer_param(F.col("v")).alias("p")).collect()
    for r in rows:
        kind, value = VALUES[r.v]
        got = {"int": r.p.int_value, "float": r.p.double_value, "bool": r.p.bool_value, "list": r.p["items"]}.get(kind)
        assert (r.p.kind, got) == (kind, value), r.v


SCORES = [(1, 0, [1.0, 1.0]), (2, 1, [1000.0, -1000.0]), (3, -100, [0.0, 9.0]), (4, 1, [0.0, 2.0])]


def test_losses(spark):
    s = spark.createDataFrame(SCORES, "sample_id long, label int, logits array<double>")
    rows = [r for r in SCORES if r[1] >= 0]
    ce = [np.logaddexp.reduce(x) - x[y] for _, y, x in rows]
    assert L.cross_entropy(s).first().loss == pytest.approx(np.mean(ce))
    w = {0: 2.0, 1: 0.5}
    weighted = L.attach_class_weight(s, spark.createDataFrame(list(w.items()), "label int, weight double"))
    u = np.array([w[y] for _, y, _ in rows])
    assert L.cross_entropy(weighted).first().loss == pytest.approx((u * ce).sum() / u.sum())
    l = u * ce
    assert L.focal_loss(weighted, 2.0).first().loss == pytest.approx(((1 - np.exp(-l)) ** 2 * l).mean())
    margins = {0: 0.5, 1: 0.2}
    m = L.attach_class_weight(s, spark.createDataFrame([(k, v) for k, v in margins.items()], "label int, margin double"), ("margin",))
    z = [[30 * (v - margins[y] * (i == y)) for i, v in enumerate(x)] for _, y, x in rows]
    assert L.loss(m, "LDAMLoss").first().loss == pytest.approx(np.mean([np.logaddexp.reduce(v) - v[y] for v, (_, y, _) in zip(z, rows, strict=True)]))
    assert [r.p for r in s.select(L.argmax_class(F.col("logits")).alias("p")).collect()] == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        L.loss(s, "Hinge")


def test_metrics_skip_unused_classes(spark):
    s = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    matrix = E.confusion_matrix(s, spark.createDataFrame([(0,), (1,), (2,)], "label int"))
    assert matrix.count() == 9
    r = E.metrics(matrix, "Accuracy, Precision,f1").first()
    assert (r.Accuracy, r.Precision) == (0.75, 0.75) and r.F1 == pytest.approx(2 / 3)
    assert max(x.percent for x in E.confusion_percent(matrix).where("label = 2").collect()) == 0
    with pytest.raises(ValueError):
        E.metrics(matrix, "Kappa")


def test_early_stop(spark):
    def stop(losses, patience):
        return T.early_stop(spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(losses)], "run_id int, epoch int, loss double"), patience).first().stop_epoch

    assert stop([3.0, 2.0, 2.0, 2.0, 2.0], 3) == 5 and stop([3.0, 2.0, 2.0, 2.0, 1.0], 3) is None and stop([3.0, 3.0, 3.0], 1) is None
    kept = T.best_epoch(spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 3, 1.0)], "run_id int, epoch int, loss double")).first()
    assert kept.epoch == 2


def test_batches(spark):
    rows = spark.range(0, 1003, 1, 5).select((F.lit(5000) - F.col("id")).alias("x"))
    got = T.assign_batches(rows, 64, ("x",)).collect()
    assert len(got) == 1003 // 64 * 64 and all(r.batch_id == (r.x - 3998) // 64 for r in got)
    assert T.assign_batches(rows.limit(5), 64, ("x",)).count() == 0
    assert {r.batch_id for r in T.assign_batches(rows.limit(5), 2, ("x",), drop_last=False).collect()} == {0, 1, 2}


def test_channel_statistics(spark):
    data = [[0.0, 0.5, 1.0, 1.0, 0.5, 0.0], [0.2, 0.4, 0.6]]
    images = spark.createDataFrame([(d,) for d in data], "data array<double>")
    flat = np.array(sum(data, [])).reshape(-1, 3)
    for ddof in (0, 1):
        for r in P.channel_stats(images, ddof=ddof).collect():
            assert (r["mean"], r["std"]) == pytest.approx((flat[:, r.channel].mean(), flat[:, r.channel].std(ddof=ddof)))
    assert {r["std"] for r in P.channel_stats(images.limit(0).union(images.where(F.size("data") == 3))).collect()} == {0.0}


def test_layouts_return(spark):
    row = spark.createDataFrame([(2, 4, [float(i) for i in range(24)])], "height int, width int, data array<double>")
    d, h, w = F.col("data"), F.col("height"), F.col("width")
    same = [P.to_hwc(P.to_chw(d, h, w), h, w), P.hflip(P.hflip(d, w, 3), w, 3), P.vflip(P.vflip(d, h, w, 3), h, w, 3), P.transpose(P.transpose(d, h, w, 3), w, h, 3), P.reorder_channels(P.reorder_channels(d))]
    for c in same:
        assert row.select(c.alias("x")).first().x == row.first().data
    x = np.arange(24.0).reshape(2, 4, 3)
    for c, want in ((P.to_chw(d, h, w), x.transpose(2, 0, 1)), (P.hflip(d, w, 3), x[:, ::-1]), (P.transpose(d, h, w, 3), x.transpose(1, 0, 2))):
        assert row.select(c.alias("x")).first().x == want.ravel().tolist()


def test_resize(spark):
    assert P.resize_weights(2, 4, "bilinear").tolist() == [[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]]
    assert P.resize_weights(4, 2, "bilinear").tolist() == [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]]
    assert np.allclose(P.resize_weights(4, 2, "triangular"), np.array([[3, 3, 1, 0], [0, 1, 3, 3]]) / 7)
    row = spark.createDataFrame([(2, 2, [0.0, 1.0, 2.0, 3.0])], "height int, width int, data array<double>")
    assert P.resize(row, 1, channels=1).first().data == [1.5]


def test_warps():
    rng = np.random.default_rng(0)
    image = rng.random((40, 32, 3))
    assert np.allclose(G.warp(image), image) and np.allclose(G.warp(image[:32], degrees=90), np.rot90(image[:32], -1))
    for _, name, _, _ in G.CATALOGUE:
        out = G.apply_one(name, image, np.random.default_rng(1))
        assert out.shape == (image.transpose(1, 0, 2) if name == "transpose" else image).shape and np.isfinite(out).all()
        assert np.array_equal(out, G.apply_one(name, image, np.random.default_rng(1)))
    assert (G.apply_one("shadow", image, np.random.default_rng(2))[:20] == image[:20]).all()
    assert G.reflect(np.array([-1.0, 0, 4, 5]), 5).tolist() == [1, 0, 4, 3]
    with pytest.raises(ValueError):
        G.apply_one("blur", image, rng)


def test_augment(spark):
    rows = [(i, 20, 20, np.random.default_rng(i).random(1200).tolist(), 1.5, [0.5] * 3, [0.25] * 3) for i in range(12)]
    s = spark.createDataFrame(rows, "sample_id long, height int, width int, data array<double>, p_scale double, mean array<double>, std array<double>")
    done = {r.sample_id: r.data for r in G.augment(s, 7, 8).collect()}
    assert done == {r.sample_id: r.data for r in G.augment(s.repartition(5), 7, 8).collect()} and {len(d) for d in done.values()} == {192}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    jvm = spark._jvm
    for name, kind, n in (("b", "png", 2), ("a", "jpg", 1), ("c", "tif", 1)):
        os.makedirs(root / name / "deep", exist_ok=True)
        for i in range(n):
            image = jvm.java.awt.image.BufferedImage(4, 3, 10 if kind == "tif" else 1)
            for x in range(4):
                for y in range(3):
                    image.setRGB(x, y, (255 << 24 | x << 16 | y << 8 | i) - (1 << 32))
            assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(root / name / f"{i}.{kind}")))
    (root / "a" / "bad.png").write_bytes(b"nothing")
    (root / "a" / "plain").write_bytes(b"x")
    (root / "b" / "deep" / "x.png").write_bytes(b"x")
    return f"file://{root}"


def test_scan_and_decode(spark, tree):
    m = M.sample_index(M.with_class_index(io.scan_images(spark, tree)))
    got = sorted((r.class_name, r.class_idx, r.sample_idx, r.path.rsplit("/", 1)[1]) for r in m.collect())
    assert got == [("a", 0, 0, "0.jpg"), ("a", 0, 1, "bad.png"), ("a", 0, 2, "plain"), ("b", 1, 0, "0.png"), ("b", 1, 1, "1.png"), ("c", 2, 0, "0.tif")]
    assert io.scan_images(spark, tree, "*.jpg").count() == 1 and io.scan_images(spark, f"{tree}/c", "*.{tif,tiff}", flat=True).count() == 1
    assert io.by_extension(m, ".tif", ".tiff").count() == 1
    images = io.decode_images(spark, tree, "*.{png,jpg,tif}")
    assert images.count() == 4 and io.decode_images(spark, tree, "*.{png,jpg,tif}", keep_bad=True).where("image is null").count() == 1
    png = images.where(F.col("path").endswith("/b/1.png")).first().image
    assert (png.height, png.width, png.nChannels) == (3, 4, 3) and np.array(png.data).reshape(3, 4, 3)[2, 3].tolist() == [3, 2, 1]
    gray = images.where(F.col("path").endswith(".tif")).first().image
    assert len(gray.data) == 36 and gray.data[0] == gray.data[1] == gray.data[2]
    joined = m.join(images, "path")
    assert joined.count() == 4


def test_text_inputs_and_sinks(spark, tmp_path):
    def path(name, text):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    assert sorted(map(tuple, io.read_split_index(spark, path("s.txt", "0, 1\n 2 ,3 \n\nx, 4\n")).collect())) == [(0, 1), (2, 3)]
    good = {"a": [[1, 2, 3], [4, 5, 6]], "b": [[1, 1, 1], [2, 2, 2]]}
    cases = {"good": json.dumps(good), "inner": json.dumps(good | {"c": [[1], [2]]}), "flat": json.dumps(good | {"c": 3}), "none": "{]", "only": json.dumps({"default": good["a"]})}
    want = {"good": ({"a", "b"}, {"a", "b"}), "inner": ({"default"}, {"a", "b", "c"}), "flat": ({"default"}, {"a", "b"}), "none": ({"default"}, {"default"}), "only": ({"default"}, {"default"})}
    for name, text in cases.items():
        for mode, names in zip(("strict", "lenient"), want[name], strict=True):
            assert {r.class_name for r in io.read_data_stats(spark, path(f"{name}.json", text), mode).collect()} == names, (name, mode)
    assert io.read_data_stats(spark, f"file://{tmp_path}/missing.json").first()["mean"] == [0.5] * 3
    path("runs/m__01-02-25-10-11-12/p.txt", "# note\n\na: 0.80\n b : 1.5\nbroken: x\n")
    assert sorted(map(tuple, io.read_p_scale(spark, f"file://{tmp_path}/runs", "*.txt").collect())) == [("m__01-02-25-10-11-12", "a", 0.8), ("m__01-02-25-10-11-12", "b", 1.5)]
    path("runs/m__01-02-25-10-11-12/h.ini", "[Model]\nName = small\n; c\n[Data]\nimg_res=280\nratio = 0.7\n")
    params = io.read_run_params(spark, f"file://{tmp_path}/runs")
    assert sorted((r.section, r.key, r.value) for r in params.collect()) == [("Data", "img_res", "280"), ("Data", "ratio", "0.7"), ("Model", "Name", "small")]
    io.write_run_params(params, f"file://{tmp_path}/k6")
    assert {r.key: r.kind for r in spark.read.parquet(f"file://{tmp_path}/k6").collect()} == {"img_res": "int", "ratio": "float", "Name": "string"}
    run = T.run_catalog(spark.createDataFrame([("m__01-02-25-10-11-12",), ("odd",)], "run_id string")).orderBy("run_id").collect()
    assert (run[0].model_type, str(run[0].started)) == ("m", "2025-02-01 10:11:12") and run[1].started is None
    stats = spark.createDataFrame([("default", [0.5] * 3, [0.5] * 3), ("a", [1.0] * 3, [2.0] * 3)], "class_name string, mean array<double>, std array<double>")
    io.write_data_stats(stats, f"file://{tmp_path}/k2")
    assert [r.class_name for r in io.read_data_stats(spark, f"file://{tmp_path}/k2").collect()] == ["a"]
    split = spark.createDataFrame([("train", 0, 1), ("val", 2, 3)], "split string, class_idx int, sample_idx int")
    io.write_split_index(split, f"file://{tmp_path}/k3")
    assert io.read_split_index(spark, f"file://{tmp_path}/k3/split=val").first().sample_idx == 3
    io.write_class_table(spark.createDataFrame([("r", "a", 2, 0.804)], "run_id string, class_name string, factor int, p_scale double"), f"file://{tmp_path}/k4")
    assert spark.read.parquet(f"file://{tmp_path}/k4").first().p_scale == 0.8
    io.write_metric_history(spark.createDataFrame([("r", 1, 0.123456)], "run_id string, epoch int, loss double"), f"file://{tmp_path}/k5")
    assert spark.read.parquet(f"file://{tmp_path}/k5").first().loss == 0.1235


def test_stats_fall_back(spark):
    s = spark.createDataFrame([(1, "a"), (2, "z")], "sample_id long, class_name string")
    stats = spark.createDataFrame([("a", [1.0] * 3, [2.0] * 3)], "class_name string, mean array<double>, std array<double>")
    assert {r.sample_id: r["mean"][0] for r in P.attach_stats(s, stats).collect()} == {1: 1.0, 2: 0.5}
    both = stats.unionByName(spark.createDataFrame([("default", [0.1] * 3, [0.2] * 3)], stats.schema))
    assert {r["mean"][0] for r in P.attach_stats(s, both, by="global").collect()} == {0.1}


def test_stream_grows_with_files(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    for i in range(3):
        rows.where(F.col("id") % 3 == i).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        got = sorted(map(tuple, ST.run_available(ST.streaming_channel_stats(stream, ("k",), "v")).collect()))
        want = sorted(map(tuple, spark.read.parquet(path).groupBy("k").agg(F.count("v"), F.avg("v"), F.stddev_samp("v")).collect()))
        assert got == [pytest.approx(w) for w in want]


def test_a_photograph_takes_seconds(spark, tmp_path):
    """280 x 280 pixels decoded, measured and augmented: nothing is worked out again for every element."""
    from time import time

    side = 280
    (tmp_path / "a").mkdir()
    picture = spark._jvm.java.awt.image.BufferedImage(side, side, 1)
    for i in range(0, side, 7):
        picture.setRGB(i, side - 1 - i, 0x102030 + i)
    spark._jvm.javax.imageio.ImageIO.write(picture, "png", spark._jvm.java.io.File(str(tmp_path / "a" / "x.png")))
    began = time()
    image = io.decode_images(spark, str(tmp_path)).select(F.lit(1).alias("sample_id"), "image.height", "image.width", F.transform("image.data", lambda v: v / 255).alias("data"))
    stats = {r.channel: r.mean for r in P.channel_stats(image).collect()}
    lit = [sum(((0x102030 + i) >> s) & 255 for i in range(0, side, 7)) / 255 / side**2 for s in (16, 8, 0)]
    assert [round(stats[c], 9) for c in range(3)] == [round(v, 9) for v in lit]
    three = F.array(*[F.lit(0.5)] * 3)
    done = G.augment(image.withColumns({"p_scale": F.lit(1.5), "mean": three, "std": three}), 3, side).select(F.size("data").alias("n")).collect()
    assert done[0].n == 3 * side * side
    wide = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda v: (v * (F.col("id") + 1) % 97) / 10).alias("logits"))
    assert wide.select(F.aggregate(L.softmax(F.col("logits")), F.lit(0.0), lambda a, v: a + v).alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert time() - began < 60


def test_one_class_of_nearly_all_rows(spark):
    """Ranks of a class that lies in many partitions go on from one to the next."""
    rows = spark.range(5000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("class_name")).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = {r.sample_id: r.rank for r in S.shuffle_rank(rows, 42, "class_name").collect()}
    spark.conf.set("spark.sql.adaptive.enabled", before)
    import hashlib

    for name, ids in (("b", range(0, 5000, 10)), ("a", [i for i in range(5000) if i % 10])):
        order = sorted(ids, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert [got[i] for i in order] == list(range(1, len(order) + 1)), name
