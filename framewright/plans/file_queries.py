"""Queries that write files made from the tables and read them back, with oracles on the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import history as T
from ..operators import manifest as M
from ..operators import pixels as P
from ..sources import io
from ..sources.files import png_bytes, write_files
from ..sources.runs import save_run, scoring_samples
from ..sources.shared import checkpointed, shared_folder, spread
from ..sources.tensors import image_struct, read_tensors, write_tensors
from . import views as V
from .queries import MANIFEST, OFF_TIES, RGB, SPLIT, _factors, _manifest, _rgb, _split, query, r, table


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Channels of a picture that tell when they have changed places: the value, its complement, and a third of neither.
COLOURS = "SELECT sample_id, class_name, i, c, CASE c WHEN 0 THEN p WHEN 1 THEN 255 - p ELSE (p * 7) % 256 END AS v FROM v_pix, range(3) q(c)"
#: A picture's file extension comes from its id.
KIND = "CASE WHEN substr(md5(CAST(sample_id AS VARCHAR)), 1, 1) < '8' THEN 'png' ELSE 'jpg' END"
PICTURES = f"SELECT DISTINCT sample_id, class_name, sample_id || '.' || {KIND} AS file FROM v_pix"


def _pictures(spark, d) -> DataFrame:
    """v_images in three colours, 0 to 255, with a file name."""
    kind = F.when(F.substring(F.md5(F.col("sample_id").cast("string")), 1, 1) < "8", "png").otherwise("jpg")
    data = F.flatten(F.transform("data", lambda v: F.array(v, 255 - v, (v * 7) % 256)))
    return V.v_images(spark, d).withColumn("data", data).withColumn("file", F.concat(F.col("sample_id").cast("string"), F.lit("."), kind))


def _picture_folder(spark, d, flat: bool = False) -> str:
    """A folder of PNG files, one for each row of embeddings, by class; and a broken one in each class."""
    root, pictures = _folder(spark, "pictures"), _pictures(spark, d)
    place = F.col("file") if flat else F.concat_ws("/", "class_name", "file")
    good = spread(pictures, "sample_id").select(place.alias("path"), png_bytes("height", "width", F.lit(3), "data").alias("content"))
    if flat:
        write_files(good, root)
        return root
    broken = pictures.select("class_name").distinct().select(F.concat("class_name", F.lit("/broken.png")).alias("path"), F.lit(b"\x89PNG but no picture").alias("content"))
    write_files(good.unionByName(broken), root)
    return root


def _file_name():
    return F.regexp_extract("path", r"([^/]+)$", 1).alias("file")


@query("s1_scan_images", f"SELECT class_name, file, CAST(row_number() OVER (PARTITION BY class_name ORDER BY file) - 1 AS BIGINT) AS sample_idx FROM (SELECT class_name, file FROM ({PICTURES}) UNION ALL SELECT DISTINCT class_name, 'broken.png' FROM v_pix)")
def s1(spark, d):
    return M.sample_index(io.scan_images(spark, _picture_folder(spark, d))).select("class_name", _file_name(), "sample_idx")


@query("s2_scan_jpg", f"SELECT class_name, file FROM ({PICTURES}) WHERE file LIKE '%.jpg'")
def s2(spark, d):
    return io.scan_images(spark, _picture_folder(spark, d), "*.jpg").select("class_name", _file_name())


@query("s3_scan_flat", f"SELECT file FROM ({PICTURES}) WHERE file LIKE '%.png'")
def s3(spark, d):
    return io.scan_images(spark, _picture_folder(spark, d, flat=True), "*.{png,tif}", flat=True).select(_file_name())


@query("f1_by_extension", f"SELECT class_name, file FROM ({PICTURES}) WHERE file LIKE '%.jpg'")
def f1(spark, d):
    return io.by_extension(io.scan_images(spark, _picture_folder(spark, d)), ".jpg", ".jpeg").select("class_name", _file_name())


@query("s4_decode_images", f"SELECT class_name, file, CAST(i * 3 + c AS INTEGER) AS i, v FROM ({COLOURS}) JOIN ({PICTURES}) USING (sample_id, class_name) UNION ALL SELECT DISTINCT class_name, 'broken.png', -1, -1.0::DOUBLE FROM v_pix")
def s4(spark, d):
    """Every pixel of every file in its place; a broken file gives one row of -1."""
    images = io.decode_images(spark, _picture_folder(spark, d), keep_bad=True).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class_name"), _file_name(), "image.data")
    pixels = images.select("class_name", "file", F.posexplode_outer("data").alias("i", "v"))
    return pixels.withColumns({"i": F.coalesce("i", F.lit(-1)), "v": F.coalesce("v", F.lit(-1.0))})


@query("s4_image_statistics", f"SELECT class_name, CAST(c AS INTEGER) AS channel, round(avg(v / 255), 6) AS mean, round(stddev_samp(v / 255), 6) AS std FROM ({COLOURS}) GROUP BY ALL")
def s4_stats(spark, d):
    """From files to channel statistics: decoded, brought to the unit range, merged by class."""
    images = io.decode_images(spark, _picture_folder(spark, d)).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class_name"), P.scale_unit(F.col("image.data"), F.col("image.dtype")).alias("data"))
    return P.class_channel_stats(images).select("class_name", "channel", r("mean").alias("mean"), r("std").alias("std"))


def _tensors(spark, d) -> str:
    path = _folder(spark, "tensors")
    write_tensors(_pictures(spark, d).select("sample_id", "class_name", image_struct("data", "height", "width").alias("image")), path)
    return path


@query("k1_write_tensors", f"SELECT sample_id, class_name, 3 AS channels, 8 AS height, 8 AS width, CAST(c * 64 + i AS INTEGER) AS i, round(v / 255, 4) AS v FROM ({COLOURS})")
def k1(spark, d):
    back = read_tensors(spark, _tensors(spark, d))
    return back.select("sample_id", "class_name", "channels", "height", "width", F.posexplode("tensor").alias("i", "v")).withColumn("v", r(F.col("v").cast("double"), 4))


@query("k1_read_some_tensors", f"SELECT sample_id, CAST(c * 64 + i AS INTEGER) AS i, round(v / 255, 4) AS v FROM ({COLOURS}) WHERE class_name = 'c3'")
def k1_some(spark, d):
    """Two columns and one class: shards without the class are not opened, other columns not read."""
    path = _folder(spark, "tensors")
    rows = _pictures(spark, d).select("sample_id", "class_name", image_struct("data", "height", "width").alias("image"))
    write_tensors(rows.repartition("class_name"), path)
    some = read_tensors(spark, path, "sample_id", "class_name", "tensor").where("class_name = 'c3'")
    return some.select("sample_id", F.posexplode("tensor").alias("i", "v")).withColumn("v", r(F.col("v").cast("double"), 4))


@query("k2_write_data_stats", f"SELECT class_name, CAST(c AS INTEGER) AS channel, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM ({RGB}) GROUP BY ALL")
def k2(spark, d):
    """Statistics of each class as a JSON file, and what a reader makes of it."""
    path = f"{_folder(spark, 'stats')}/data_stats.json"
    io.write_data_stats(P.stats_table(P.class_channel_stats(_rgb(spark, d))), path)
    back = io.read_data_stats(spark, path)
    return back.select("class_name", F.posexplode(F.arrays_zip("mean", "std")).alias("channel", "s")).select("class_name", "channel", r("s.mean").alias("mean"), r("s.std").alias("std"))


K3 = f"SELECT split, class_idx, sample_idx FROM t_split JOIN ({MANIFEST}) USING (sample_id)"


def _split_index(spark, d) -> str:
    path = _folder(spark, "split")
    rows = _split(spark, d).select("sample_id", "split").join(_manifest(spark, d).select("sample_id", "class_idx", "sample_idx"), "sample_id")
    for _ in range(2):
        io.write_split_index(rows, path)
    return path


@query("k3_write_split_index", K3, SPLIT)
def k3(spark, d):
    """Written twice; lists of the three parts read one after another."""
    path, parts = _split_index(spark, d), None
    for name in ("train", "val", "test"):
        rows = io.read_split_index(spark, f"{path}/split={name}").select(F.lit(name).alias("split"), "class_idx", "sample_idx")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


@query("s5_read_split_index", f"SELECT s.sample_id, s.class_name FROM t_split t JOIN ({MANIFEST}) s USING (sample_id) WHERE split = 'test'", SPLIT)
def s5(spark, d):
    """The test list of a run, resolved to its samples."""
    keys = io.read_split_index(spark, f"{_split_index(spark, d)}/split=test")
    return M.resolve_split(keys, _manifest(spark, d)).select("sample_id", "class_name")


def _run_classes(spark, d) -> DataFrame:
    """The class table of each run of events, where a run's p_scale is a little its own."""
    runs = table(spark, d, "events").select((F.col("user_id") % 5).alias("k")).distinct()
    return runs.crossJoin(_factors(spark, d)).select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("run_id"), "class_name", "factor", (F.col("p_scale") + F.col("k") / F.lit(100.0)).alias("p_scale"))


RUN_CLASSES = "SELECT 'r' || k AS run_id, class_name, factor, round(p_scale + k / 100.0::DOUBLE, 2) AS p_scale FROM s_psc, (SELECT DISTINCT user_id % 5 AS k FROM events)"


@query("k4_write_class_table", RUN_CLASSES)
def k4(spark, d):
    """All runs, then two of them again: a run stands in the table once."""
    path, rows = _folder(spark, "classes"), _run_classes(spark, d)
    io.write_class_table(rows, path)
    io.write_class_table(rows.where("run_id in ('r1', 'r3')"), path)
    return io.read_by_run(spark, path).select("run_id", "class_name", "factor", "p_scale")


@query("s7_read_p_scale", f"SELECT run_id, class_name, p_scale FROM ({RUN_CLASSES})")
def s7(spark, d):
    root = _folder(spark, "runs")
    io.write_p_scale(_run_classes(spark, d), root)
    return io.read_p_scale(spark, root, "*.txt")


@query("f3_comments_and_blanks", f"SELECT run_id, count(*) AS n FROM ({RUN_CLASSES}) GROUP BY ALL")
def f3(spark, d):
    """Comments, blank lines and broken lines between those of the classes do not count."""
    root = _folder(spark, "noisy")
    lines = _run_classes(spark, d).withColumn("line", F.concat("class_name", F.lit(": "), F.col("p_scale").cast("string"), F.lit("\n\n# "), "class_name", F.lit(": 9\n   \nno number: x\n")))
    texts = lines.groupBy("run_id").agg(F.array_join(F.collect_list("line"), "").alias("content"))
    write_files(spread(texts, "run_id").select(F.concat("run_id", F.lit("/classes.txt")).alias("path"), "content"), root)
    return io.read_p_scale(spark, root).groupBy("run_id").agg(F.count("*").alias("n"))


@query("f4_stats_validity", "SELECT run_id, CASE WHEN good THEN class_name ELSE 'default' END AS class_name FROM (SELECT user_id % 5 AS run_id, 'c' || label AS class_name, (user_id % 5) % 2 = 0 AS good FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT label FROM embeddings)) GROUP BY ALL")
def f4(spark, d):
    """Measured statistics of every run; in each second run one class has a list of two, which discards the whole file."""
    stats = P.stats_table(P.class_channel_stats(_rgb(spark, d)))
    runs, out = table(spark, d, "events").select((F.col("user_id") % 5).alias("run_id")).distinct(), None
    short = stats.agg(F.max("class_name").alias("last"))
    for k in sorted(x.run_id for x in runs.collect()):
        broken = stats.crossJoin(short).withColumn("mean", F.when((F.col("class_name") == F.col("last")) & F.lit(k % 2 == 1), F.slice("mean", 1, 2)).otherwise(F.col("mean"))).drop("last")
        path = f"{_folder(spark, 'stats')}/data_stats.json"
        io.write_data_stats(broken, path)
        rows = io.read_data_stats(spark, path).select(F.lit(k).cast("long").alias("run_id"), "class_name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("k5_write_metric_history", "SELECT 'r' || run_id AS run_id, phase, epoch, round(sum(loss * batch_size) / sum(batch_size) + 1e-7::DOUBLE, 4) AS loss FROM v_history GROUP BY ALL")
def k5(spark, d):
    path = _folder(spark, "history")
    rows = T.epoch_loss(V.v_history(spark, d)).withColumn("run_id", F.concat(F.lit("r"), F.col("run_id").cast("string"))).withColumn("loss", F.col("loss") + OFF_TIES)
    io.write_metric_history(rows, path)
    io.write_metric_history(rows.where("run_id = 'r2'"), path)
    return io.read_by_run(spark, path).select("run_id", "phase", "epoch", "loss")


K6 = "SELECT 'u' || user_id AS run_id, event_type AS section, 'k' AS key, CAST(count(*) AS BIGINT) AS int_value FROM events GROUP BY ALL"


@query("k6_write_run_params", K6)
def k6(spark, d):
    """Settings files of all runs, read in one scan, typed, and written as a table by run, twice."""
    root, path = _folder(spark, "settings"), _folder(spark, "params")
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    part = F.concat(F.lit("["), "event_type", F.lit("]\n; note\nk = "), F.col("n").cast("string"))
    texts = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id")).agg(F.array_join(F.collect_list(part), "\n").alias("content"))
    write_files(spread(texts, "run_id").select(F.concat("run_id", F.lit("/settings.ini")).alias("path"), "content"), root)
    params = checkpointed(io.read_run_params(spark, root))
    for _ in range(2):
        io.write_run_params(params, path)
    return io.read_by_run(spark, path).select("run_id", "section", "key", F.col("int_value").cast("long").alias("int_value"))


@query(
    "run_to_scoring",
    f"""SELECT class_name, file, class_idx, sample_idx, round(p_scale, 2) AS p_scale, mean, std FROM (
  SELECT class_name, file, CAST(dense_rank() OVER (ORDER BY class_name) - 1 AS INTEGER) AS class_idx, CAST(row_number() OVER (PARTITION BY class_name ORDER BY file) - 1 AS INTEGER) AS sample_idx FROM ({PICTURES}))
  JOIN (SELECT class_name, round_even(least(2.0::DOUBLE, 0.5::DOUBLE + CAST(factor AS DOUBLE) / max(factor) OVER ()), 2) AS p_scale FROM (
    SELECT class_name, least(greatest(ceil(median(n) OVER () / n * 2), 1), 10) AS factor FROM (SELECT class_name, count(*) AS n FROM ({PICTURES}) GROUP BY ALL))) USING (class_name)
  JOIN (SELECT class_name, round(avg(v / 255), 6) AS mean, round(stddev_samp(v / 255), 6) AS std FROM ({COLOURS}) WHERE c = 0 GROUP BY ALL) USING (class_name)
  WHERE sample_idx % 3 = 0""",
)
def run_to_scoring(spark, d):
    """A run saves its lists over a folder of pictures; another reads them back. Its test list is each third file of a class."""
    pictures, root = _pictures(spark, d), _folder(spark, "saved")
    images = _folder(spark, "pictures")
    write_files(spread(pictures, "sample_id").select(F.concat_ws("/", "class_name", "file").alias("path"), png_bytes("height", "width", F.lit(3), "data").alias("content")), images)
    manifest = M.sample_index(M.with_class_index(io.scan_images(spark, images)))
    factors = B.p_scale(B.repeat_factor(M.class_counts(manifest)))
    stats = P.stats_table(P.class_channel_stats(pictures.withColumn("data", P.scale_unit(F.col("data"), F.lit("uint8")))))
    split = manifest.withColumn("split", F.when(F.col("sample_idx") % 3 == 0, "test").otherwise("train"))
    save_run(split, factors, stats, root, "m__01-02-25-10-11-12")
    found = scoring_samples(spark, images, root, "m__01-02-25-10-11-12", by="class")
    return found.select("class_name", _file_name(), "class_idx", "sample_idx", "p_scale", r(F.col("mean")[0]).alias("mean"), r(F.col("std")[0]).alias("std"))
