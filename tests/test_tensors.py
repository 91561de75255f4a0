import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import tensors as T
from framewright.sources.files import write_files

SCHEMA = "id long, label string, day date, image struct<height:int,width:int,nChannels:int,layout:string,dtype:string,data:array<double>>"


def rows_of(n, seed=0):
    import datetime

    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        h, w, c = [(4, 6, 3), (4, 6, 3), (5, 5, 1)][i % 3]
        kind = ["uint8", "float32"][i % 2]
        data = rng.integers(0, 256, h * w * c).astype(float) if kind == "uint8" else rng.uniform(-0.2, 1.2, h * w * c)
        out.append((i, None if i == 7 else f"l{i % 4}", datetime.date(2024, 1, 1 + i % 20), (h, w, c, ["HWC", "CHW"][i % 5 == 0], kind, data.tolist())))
    return out


def want(row):
    h, w, c, layout, kind, data = row[3]
    x = np.array(data).reshape((c, h, w) if layout == "CHW" else (h, w, c))
    x = x if layout == "CHW" else x.transpose(2, 0, 1)
    return np.clip(x / (255 if kind == "uint8" else 1), 0, 1).astype(np.float32)


@pytest.mark.parametrize("shard_bytes", [1, 2000, 1 << 26])
def test_round_trip(spark, tmp_path, shard_bytes):
    rows = rows_of(60)
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    T.write_tensors(df.where("id < 40"), path, shard_bytes=shard_bytes)
    T.write_tensors(df.where("id >= 40"), path, shard_bytes=shard_bytes)
    got = {r.id: r for r in T.read_tensors(spark, path, part_bytes=1500).collect()}
    assert len(got) == 60
    for row in rows:
        r = got[row[0]]
        assert (r.label, r.day) == row[1:3] and np.array_equal(np.array(r.tensor, np.float32).reshape(r.channels, r.height, r.width), want(row))
    index = json.loads((tmp_path / "t" / T.INDEX).read_text())
    arrays = [np.load(tmp_path / "t" / f"{s['name']}.npy", mmap_mode="r") for s in index["shards"]]
    assert all(a.dtype == np.float32 and list(a.shape) == [s["rows"], *s["shape"]] for a, s in zip(arrays, index["shards"], strict=True)) and sum(map(len, arrays)) == 60
    T.write_tensors(df.where("id < 5"), path, "overwrite")
    assert T.read_tensors(spark, path).count() == 5
    assert T.INDEX in os.listdir(tmp_path / "t") and len([n for n in os.listdir(tmp_path / "t") if not n.startswith(".")]) == 1 + 2 * len(json.loads((tmp_path / "t" / T.INDEX).read_text())["shards"])


def test_columns_and_shards_are_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    T.write_tensors(spark.createDataFrame(rows_of(60), SCHEMA).repartitionByRange(6, "id"), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    few = T.read_tensors(spark, path, "id", "height")
    assert few.columns == ["id", "height"] and few.count() == 60
    for condition, n in [("id < 10", 10), ("id = 25", 1), ("id in (3, 59)", 2), ("height = 5", 20), ("label is null", 1), ("day >= date'2024-01-15' and id > 30", None), ("label = 'l1'", 15), ("id > 100", 0)]:
        some = T.read_tensors(spark, path).where(condition)
        assert n is None or some.count() == n, condition
    whole = T.read_tensors(spark, path).rdd.getNumPartitions()
    assert T.read_tensors(spark, path).where("id < 10").rdd.getNumPartitions() < whole
    for shard in json.loads((tmp_path / "t" / T.INDEX).read_text())["shards"]:
        if shard["range"]["id"][0] >= 10:
            os.remove(tmp_path / "t" / f"{shard['name']}.npy")
            os.remove(tmp_path / "t" / f"{shard['name']}.parquet")
    assert T.read_tensors(spark, path).where("id < 10").count() == 10


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = rows_of(30)
    T.write_tensors(spark.createDataFrame(rows[:9], SCHEMA), path)
    before = sorted(os.listdir(tmp_path / "t"))
    rows[20] = (*rows[20][:3], (9, 9, 9, "HWC", "uint8", [1.0]))
    with pytest.raises(Exception, match="another number of values"):
        T.write_tensors(spark.createDataFrame(rows, SCHEMA).repartition(4), path, shard_bytes=1)
    assert sorted(os.listdir(tmp_path / "t")) == before and T.read_tensors(spark, path).count() == 9
    with pytest.raises(Exception, match="other columns"):
        T.write_tensors(spark.createDataFrame(rows[:3], SCHEMA).drop("label"), path)
    assert sorted(os.listdir(tmp_path / "t")) == before


def test_odd_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([*rows_of(3), (50, "x", None, None)], SCHEMA)
    T.write_tensors(df, path)
    assert json.loads((tmp_path / "t" / T.INDEX).read_text())["skipped"] == 1 and T.read_tensors(spark, path).count() == 3
    T.write_tensors(df.select("image"), f"{path}2")
    assert T.read_tensors(spark, f"{path}2").columns == ["channels", "height", "width", "tensor"] and T.read_tensors(spark, f"{path}2").count() == 3
    T.write_tensors(df.limit(0), f"{path}3")
    assert T.read_tensors(spark, f"{path}3").collect() == []
    with pytest.raises(Exception, match="of these names"):
        T.write_tensors(df.withColumn("height", F.lit(1)), f"{path}4")
    with pytest.raises(Exception, match="no tensors"):
        T.read_tensors(spark, f"{path}5").count()


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b/1.bin", b"x" * 100_000), ("2.bin", b""), ("a/3.bin", None)], "path string, content binary")
    write_files(rows, f"file://{tmp_path}/f")
    found = {os.path.relpath(os.path.join(d, n), tmp_path / "f"): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(tmp_path / "f") for n in names if not n.startswith(".")}
    assert found == {"a/b/1.bin": 100_000, "2.bin": 0, "a/3.bin": 0}
    bad = spark.createDataFrame([("ok.bin", b"1"), ("../out.bin", b"2")], "path string, content binary").coalesce(1)
    with pytest.raises(Exception, match="not a path below"):
        write_files(bad, f"file://{tmp_path}/g")
    assert not (tmp_path / "g" / "ok.bin").exists() and not (tmp_path / "out.bin").exists()


def test_decoded_files_come_in_bounded_partitions(spark, tmp_path):
    """The scan packs files by their size: no partition holds more than the set number of bytes, unless one file does."""
    from framewright.sources.files import png_bytes
    from framewright.sources.io import decode_images

    pixels = F.transform(F.sequence(F.lit(1), F.lit(3 * 64 * 64)), lambda i: (F.xxhash64(i, F.col("id")) % 128 + 128).cast("double"))
    rows = spark.range(12).select(F.concat(F.lit("c/"), F.col("id").cast("string"), F.lit(".png")).alias("path"), png_bytes(F.lit(64), F.lit(64), F.lit(3), pixels).alias("content"))
    write_files(rows, f"file://{tmp_path}/p")
    total = sum(os.path.getsize(tmp_path / "p" / "c" / n) for n in os.listdir(tmp_path / "p" / "c"))
    set_before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(total // 4))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        images = decode_images(spark, f"file://{tmp_path}/p")
        assert images.rdd.getNumPartitions() >= 4 and images.where(F.size("image.data") == 3 * 64 * 64).count() == 12
    finally:
        for k, v in set_before.items():
            spark.conf.set(k, v)


def test_pictures_are_written_in_many_tasks_and_read_once(spark, tmp_path):
    """A table in one partition: its files come from many tasks, a broken one gives its row from the same scan, paths come in few partitions."""
    from framewright.plans import file_queries as Q
    from framewright.sources import io

    rows = [(i, [((i * 37 + k * 11) % 100) / 100 - 0.5 for k in range(64)], i % 2) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    d, tracker = f"file://{tmp_path}", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pictures", "pictures")
    folder = Q._picture_folder(spark, d)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("pictures") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) >= 3 * spark.sparkContext.defaultParallelism
    decoded = Q.s4(spark, d)
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    got = decoded.collect()
    assert sum(x.i == -1 and x.v == -1.0 and x.file == "broken.png" for x in got) == 2 and len(got) == 40 * 192 + 2
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
        files = io.scan_images(spark, folder)
        assert files.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism and files.count() == 42
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_statistics_decode_each_picture_once(spark, tmp_path):
    from framewright.operators import pixels as P
    from framewright.plans import file_queries as Q

    rows = [(i, [((i * 37 + k * 11) % 100) / 100 - 0.5 for k in range(64)], i % 2) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    plan = Q.s4_stats(spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [_rgb(") == 1
    odd = spark.createDataFrame([("a", [0.0, 1.0]), ("a", None), ("a", []), ("b", None)], "class_name string, data array<double>")
    assert [(x.class_name, x["mean"]) for x in P.class_channel_stats(odd, channels=1).collect()] == [("a", 0.5)]
