import pytest
from pyspark.sql import functions as F

from framewright.operators.pixels import channel_stats
from framewright.sources import io
from framewright.streaming import stats as ST
from framewright.streaming.store import ResultStore


def rows_of(df):
    return sorted((r["class_name"], r["channel"], round(r["mean"], 9), round(r["std"], 9)) for r in df.collect())


def test_runs_go_on_from_each_other(spark, tmp_path):
    images = spark.range(60).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("class_name"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.rand(3) + i).alias("data"))
    images.write.parquet(f"file://{tmp_path}/all")
    images = spark.read.parquet(f"file://{tmp_path}/all")

    def run():
        stream = spark.readStream.schema(images.schema).parquet(f"file://{tmp_path}/in")
        return ST.run_available(ST.streaming_image_stats(stream, ("class_name",)), f"file://{tmp_path}/job")

    def drop(condition):
        images.where(condition).write.mode("append").parquet(f"file://{tmp_path}/in")

    drop("class_name = 'c0'")
    first = rows_of(run())
    assert first == rows_of(channel_stats(images.where("class_name = 'c0'"), by=("class_name",))) and rows_of(run()) == first
    drop("class_name = 'c1'")
    drop("class_name = 'c2'")
    assert rows_of(run()) == rows_of(channel_stats(images, by=("class_name",))) == rows_of(run())


def test_store(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/s")
    schema = spark.range(1).schema
    assert store.latest(schema) is None
    for batch in range(4):
        store.write(spark.range(batch), batch)
    assert store.versions() == [2, 3] and store.latest(schema).count() == 3
    store.write(spark.range(9), 3)
    (tmp_path / "s" / "batch-4").mkdir()
    (tmp_path / "s" / "batch-4" / "part-0.parquet").write_bytes(b"cut short")
    assert store.latest(schema).count() == 9
    store.write(spark.range(5), 0)
    assert store.versions() == [0] and store.latest(schema).count() == 5


def test_nothing_at_all(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("class_name string, data array<double>").parquet(f"file://{tmp_path}/in")
    assert ST.run_available(ST.streaming_image_stats(stream, ("class_name",)), f"file://{tmp_path}/job").count() == 0


def test_table_by_run_has_few_files(spark, tmp_path):
    """Files of a table grow with its writes, not its runs; the last whole write of a run counts, null and empty ids included."""
    path = f"file://{tmp_path}/t"
    runs = [None, "", "1", *(f"u{i}" for i in range(300))]
    rows = spark.createDataFrame([(x, k, 0) for x in runs for k in range(2)], "run_id string, epoch int, loss int").coalesce(2)
    for _ in range(2):
        io.write_by_run(rows, path)
    assert len(list((tmp_path / "t").glob("**/*.parquet"))) <= 4
    some = spark.createDataFrame([(None, 7, 7), ("u1", 7, 7), ("new", 7, 7)], rows.schema)
    io.write_by_run(some, path)
    cut = tmp_path / "t" / "write=000000009-cut"
    cut.mkdir()
    (cut / "part-0.parquet").write_bytes(b"cut short")
    got = sorted((tuple(x) for x in io.read_by_run(spark, path).select("run_id", "epoch", "loss").collect()), key=repr)
    want = [(x, k, 0) for x in runs for k in range(2) if x not in (None, "u1")] + [(x, 7, 7) for x in (None, "u1", "new")]
    assert got == sorted(want, key=repr)
    with pytest.raises(ValueError, match="no table by run"):
        io.read_by_run(spark, f"{path}-none")


def test_settings_of_many_runs_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / "runs" / f"u{i}").mkdir(parents=True)
        (tmp_path / "runs" / f"u{i}" / "s.ini").write_text(f"[a]\nk = {i}\n")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("listing", "settings")
    params = io.read_run_params(spark, f"file://{tmp_path}/runs")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages if s) <= 12 and spark.conf.get(name) == before
    assert {(x.run_id, x.value) for x in params.collect()} == {(f"u{i}", str(i)) for i in range(200)}
