"""Test views on the supplied tables: DataFrames, and the same in DuckDB SQL as named parts of a WITH list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.classify import centroid_scores
from ..operators.losses import argmax_class


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _by_bits(rows: DataFrame, id_: str, size: str) -> DataFrame:
    bits = F.length(F.bin(F.col(size))).cast("string")
    return rows.select(F.col(id_).alias("sample_id"), F.concat(F.lit("b"), F.lpad(bits, 2, "0")).alias("class_name"))


def v_samples(spark, d) -> DataFrame:
    return _by_bits(table(spark, d, "documents"), "doc_id", "n_chars")


def v_orders(spark, d) -> DataFrame:
    return _by_bits(table(spark, d, "orders"), "o_orderkey", "o_custkey")


def v_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def v_images(spark, d) -> DataFrame:
    """8 x 8, one channel, uint8 values as doubles."""
    pixel = F.transform("vec", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x + 1) * 127.5).cast("double"))))
    return v_vectors(spark, d).select("sample_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixel.alias("data"))


def v_tokens(spark, d) -> DataFrame:
    rows = v_vectors(spark, d).select(F.expr("sample_id div 2").alias("image_id"), (F.col("sample_id") % 2).cast("int").alias("layer"), "vec")
    return rows.select("image_id", "layer", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.struct(t.alias("token_idx"), F.slice("vec", t * 8 + 1, 8).alias("vec")))).alias("t")).select("image_id", "layer", "t.*")


def v_scores(spark, d) -> DataFrame:
    v = v_vectors(spark, d)
    s = centroid_scores(v.where("sample_id % 5 <> 0"), v.where("sample_id % 5 = 0"))
    return s.withColumn("pred", argmax_class(F.col("logits")))


def v_whole(spark, d) -> DataFrame:
    """As v_scores, for every vector."""
    v = v_vectors(spark, d)
    return centroid_scores(v.where("sample_id % 5 <> 0"), v).withColumn("pred", argmax_class(F.col("logits")))


def v_binary(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("label"), F.col("toxic").alias("pred"))


def v_history(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    day = F.to_date("ts")
    first = e.agg(F.min(day).alias("first"))
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    phase = F.when(F.col("event_type").isin("purchase", "signup"), "val").otherwise("train")
    rows = e.crossJoin(first).select((F.col("user_id") % 5).alias("run_id"), phase.alias("phase"), (F.datediff(day, "first") + 1).alias("epoch"), "event_id", (k + 1).alias("batch_size"), F.col("value").alias("loss"), F.create_map(F.lit("Accuracy"), k / 100.0, F.lit("F1"), 1 - k / 200.0).alias("metrics"))
    return rows.withColumn("batch_idx", F.row_number().over(Window.partitionBy("run_id", "phase", "epoch").orderBy("event_id")) - 1)


def v_epochs(spark, d) -> DataFrame:
    """Validation loss and accuracy by run and epoch, rounded, so that both engines compare equal numbers."""
    from ..operators.history import epoch_loss, epoch_metrics

    h = v_history(spark, d).where("phase = 'val'")
    loss = epoch_loss(h).select("run_id", "epoch", F.round("loss", 6).alias("loss"))
    acc = epoch_metrics(h).where("metric = 'Accuracy'").select("run_id", "epoch", F.round("value", 6).alias("Accuracy"))
    return loss.join(acc, ["run_id", "epoch"])


#: The same views in DuckDB SQL. Each may use those before it.
SQL = {
    "v_samples": "SELECT doc_id AS sample_id, 'b' || lpad(CAST(length(bin(n_chars)) AS VARCHAR), 2, '0') AS class_name FROM documents",
    "v_orders": "SELECT o_orderkey AS sample_id, 'b' || lpad(CAST(length(bin(o_custkey)) AS VARCHAR), 2, '0') AS class_name FROM orders",
    "v_vec": "SELECT vec_id AS sample_id, label, CAST(i AS INTEGER) AS i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)",
    "v_pix": "SELECT sample_id, 'c' || label AS class_name, i, least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor((x + 1) * 127.5::DOUBLE))) AS p FROM v_vec",
    "v_tok": "SELECT sample_id // 2 AS image_id, sample_id % 2 AS layer, i // 8 AS token_idx, i % 8 AS pos, x FROM v_vec",
    "v_long": "SELECT e.sample_id, e.label, c.label AS k, sum(e.x * c.m) AS logit FROM v_vec e JOIN (SELECT label, i, avg(x) AS m FROM v_vec WHERE sample_id % 5 <> 0 GROUP BY ALL) c USING (i) WHERE e.sample_id % 5 = 0 GROUP BY ALL",
    "v_row": "SELECT sample_id, label, max(logit) + ln(sum(exp(logit - mx))) AS lse, max(CASE WHEN k = label THEN logit END) AS own, min(CASE WHEN logit = mx THEN k END) AS pred FROM (SELECT *, max(logit) OVER (PARTITION BY sample_id) AS mx FROM v_long) GROUP BY ALL",
    "w_long": "SELECT e.sample_id, e.label, c.label AS k, sum(e.x * c.m) AS logit FROM v_vec e JOIN (SELECT label, i, avg(x) AS m FROM v_vec WHERE sample_id % 5 <> 0 GROUP BY ALL) c USING (i) GROUP BY ALL",
    "w_row": "SELECT sample_id, label, max(logit) + ln(sum(exp(logit - mx))) AS lse, max(CASE WHEN k = label THEN logit END) AS own, min(CASE WHEN logit = mx THEN k END) AS pred FROM (SELECT *, max(logit) OVER (PARTITION BY sample_id) AS mx FROM w_long) GROUP BY ALL",
    "v_cm": "SELECT a.label, b.label AS pred, count(r.sample_id) AS n FROM (SELECT DISTINCT label FROM v_vec) a CROSS JOIN (SELECT DISTINCT label FROM v_vec) b LEFT JOIN v_row r ON r.label = a.label AND r.pred = b.label GROUP BY ALL",
    "v_out": "SELECT c.label, sum(CASE WHEN m.label = c.label AND m.pred = c.label THEN n ELSE 0 END) AS tp, sum(CASE WHEN m.label <> c.label AND m.pred = c.label THEN n ELSE 0 END) AS fp, sum(CASE WHEN m.label = c.label AND m.pred <> c.label THEN n ELSE 0 END) AS fn FROM (SELECT DISTINCT label FROM v_vec) c, v_cm m GROUP BY ALL",
    "v_history": "SELECT user_id % 5 AS run_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'val' ELSE 'train' END AS phase, CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch, event_id, k + 1 AS batch_size, value AS loss, k FROM (SELECT *, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) AS k FROM events)",
    "v_epochs": "SELECT run_id, epoch, round(sum(loss * batch_size) / sum(batch_size), 6) AS loss, round(sum(k / 100.0::DOUBLE * batch_size) / sum(batch_size), 6) AS acc FROM v_history WHERE phase = 'val' GROUP BY ALL",
    "s_cnt": "SELECT class_name, count(*) AS n FROM v_samples GROUP BY ALL",
    "s_fac": "SELECT *, CAST(least(greatest(ceil((SELECT median(n) FROM s_cnt) / n * 2), 1), 10) AS BIGINT) AS factor FROM s_cnt",
    "s_psc": "SELECT *, round_even(least(2.0::DOUBLE, 0.5::DOUBLE + CAST(factor AS DOUBLE) / (SELECT max(factor) FROM s_fac)), 2) AS p_scale FROM s_fac",
    "o_cnt": "SELECT class_name, count(*) AS n FROM v_orders GROUP BY ALL",
    "o_fac": "SELECT *, CAST(least(greatest(ceil((SELECT median(n) FROM o_cnt) / n * 2), 1), 10) AS BIGINT) AS factor FROM o_cnt",
}


def split_sql(samples: str, factors: str, most: int, seed: int) -> str:
    """The stratified split as WITH parts t_*, ending in t_split (sample_id, class_name, split)."""
    three = "CASE WHEN {n} = 3 THEN 1 ELSE {rest} END"
    return f"""
t_all AS (SELECT s.sample_id, s.class_name, f.n, f.factor FROM {samples} s JOIN {factors} f USING (class_name) WHERE f.n >= 3),
t_one AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5('{seed}:forced:' || sample_id), sample_id) AS r, CAST(greatest(1, round_even(0.3::DOUBLE * n, 0)) AS BIGINT) AS k FROM t_all WHERE n = 3 OR factor >= 6),
t_fixed AS (SELECT sample_id, class_name, CASE WHEN r <= {three.format(n="n", rest="n - 2 * k")} THEN 'train' WHEN r <= {three.format(n="n", rest="n - 2 * k")} + {three.format(n="n", rest="k")} THEN 'val' ELSE 'test' END AS split FROM t_one),
t_rank AS (SELECT sample_id, class_name, row_number() OVER (ORDER BY md5('{seed}:cut:' || sample_id), sample_id) AS g FROM t_all WHERE NOT (n = 3 OR factor >= 6)),
t_pool AS (SELECT * FROM t_rank WHERE g <= {most} - (SELECT count(*) FROM t_fixed WHERE split <> 'test')),
t_size AS (SELECT class_name, count(*) AS m, CAST(greatest(1, round_even(0.2::DOUBLE * count(*), 0)) AS BIGINT) AS t FROM t_pool GROUP BY ALL HAVING count(*) >= 3),
t_two AS (SELECT sample_id, class_name, m, t, CAST(greatest(1, round_even((1 - 0.7::DOUBLE) * (m - t), 0)) AS BIGINT) AS v, row_number() OVER (PARTITION BY class_name ORDER BY md5('{seed}:common:' || sample_id), sample_id) AS r FROM t_pool JOIN t_size USING (class_name)),
t_common AS (SELECT sample_id, class_name, CASE WHEN r <= {three.format(n="m", rest="m - t - v")} THEN 'train' WHEN r <= {three.format(n="m", rest="m - t - v")} + {three.format(n="m", rest="v")} THEN 'val' ELSE 'test' END AS split FROM t_two),
t_split AS (SELECT * FROM t_fixed UNION ALL SELECT * FROM t_common)"""


def with_views(body: str, extra: str = "") -> str:
    """body after the WITH list of all views it names, directly or through others."""
    need, seen = body + extra, []
    for name in reversed(SQL):
        if name in need:
            seen.insert(0, name)
            need += SQL[name]
    parts = [f"{n} AS ({SQL[n]})" for n in seen] + ([extra.strip()] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
