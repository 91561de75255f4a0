"""Features from token tables, and classifiers on them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .losses import argmax_class, cross_entropy_row, softmax


def drop_cls(tokens: DataFrame) -> DataFrame:
    return tokens.where("token_idx > 0")


def concat_layers(tokens: DataFrame, n: int) -> DataFrame:
    """(image_id, token_idx, vec): each token's vectors of the last n layers, one after another."""
    last = tokens.crossJoin(tokens.agg(F.max("layer").alias("_last"))).where(F.col("layer") > F.col("_last") - n)
    joined = last.groupBy("image_id", "token_idx").agg(F.array_sort(F.collect_list(F.struct("layer", "vec"))).alias("l"))
    return joined.select("image_id", "token_idx", F.flatten(F.transform("l", lambda x: x["vec"])).alias("vec"))


def pool_patches(tokens: DataFrame) -> DataFrame:
    """(image_id, pos, value): mean over an image's tokens."""
    long = tokens.select("image_id", F.posexplode("vec").alias("pos", "x"))
    return long.groupBy("image_id", "pos").agg(F.avg("x").alias("value"))


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw", array_to_vector(F.col("vec").cast("array<double>"))).withColumn("target", F.col("label").cast("double"))


#: Weight of half the sum of squared weights in the loss of the linear head.
PENALTY = 1e-3


def fit_classifier(train: DataFrame, weight: str | None = None, max_iter: int = 50, tolerance: float = 1e-6):
    """A linear head on standardised features (vec, label); weight names a column of sample weights.

    It minimises the weighted mean of cross entropy plus PENALTY / 2 times the sum of squared weights, intercepts left out.
    """
    head = LogisticRegression(featuresCol="features", labelCol="target", maxIter=max_iter, tol=tolerance, regParam=PENALTY, family="multinomial", standardization=False)
    if weight:
        head = head.setWeightCol(weight)
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), head]).fit(_features(train))


def fit_mlp(train: DataFrame, layers: list[int], max_iter: int = 30, seed: int = 3):
    head = MultilayerPerceptronClassifier(featuresCol="features", labelCol="target", layers=layers, maxIter=max_iter, seed=seed)
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), head]).fit(_features(train))


def score(model, rows: DataFrame) -> DataFrame:
    """(sample_id, label, logits, pred, loss) of every row."""
    out = model.transform(_features(rows)).withColumn("logits", vector_to_array("rawPrediction"))
    return out.select("sample_id", "label", "logits", argmax_class(F.col("logits")).alias("pred"), cross_entropy_row(F.col("logits"), F.col("label")).alias("loss"))


def gradient(model, train: DataFrame, weight: str | None = None) -> DataFrame:
    """(label, pos, gradient) of the linear head's loss at its weights, pos -1 for the intercept: all near 0 at the optimum.

    Worked out from the weights and the rows by plain expressions, not by the library that fitted them; only one row of sums for
    each feature and task is shuffled.
    """
    scaler, head = model.stages[-2], model.stages[-1]
    weights, bias = head.coefficientMatrix.toArray().tolist(), head.interceptVector.toArray().tolist()
    classes = range(len(bias))
    rows = scaler.transform(_features(train)).select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    at = rows.sparkSession.createDataFrame([(weights, bias)], "weights array<array<double>>, bias array<double>")
    inner = F.transform("weights", lambda row, k: F.aggregate(F.zip_with("x", row, lambda a, b: a * b), F.get("bias", k), lambda s, v: s + v))
    told = rows.crossJoin(F.broadcast(at)).select("x", "y", "w", softmax(inner).alias("p"))
    off = told.select(F.posexplode(F.concat(F.array(F.lit(1.0)), "x")).alias("pos", "v"), "w", F.transform("p", lambda p, k: F.col("w") * (p - (k == F.col("y")).cast("double"))).alias("r"))
    sums = off.groupBy((F.col("pos") - 1).alias("pos")).agg(F.sum("w").alias("w"), F.array(*[F.sum(F.get("r", F.lit(k)) * F.col("v")) for k in classes]).alias("g"))
    flat = sums.select("pos", F.posexplode(F.transform("g", lambda g: g / F.col("w"))).alias("label", "g"))
    own = rows.sparkSession.createDataFrame([(k, j, weights[k][j]) for k in classes for j in range(len(weights[k]))], "label int, pos int, own double")
    return flat.join(F.broadcast(own), ["label", "pos"], "left").select("label", "pos", (F.col("g") + PENALTY * F.coalesce("own", F.lit(0.0))).alias("gradient"))


class CentroidHead:
    """The closed-form head as a model: raw predictions are inner products with class means, so `score` can be held against SQL."""

    def __init__(self, train: DataFrame):
        self.train = train

    def transform(self, rows: DataFrame) -> DataFrame:
        means = class_means(self.train)
        inner = F.transform("means", lambda m: F.aggregate(F.zip_with("vec", m, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
        return rows.crossJoin(F.broadcast(means)).withColumn("rawPrediction", array_to_vector(inner)).drop("means")


def class_means(train: DataFrame) -> DataFrame:
    """One row: the mean vectors of the classes in order of label."""
    means = train.select("label", F.posexplode("vec").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("mean"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "mean"))), lambda p: p["mean"]).alias("means"))


def centroid_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """(sample_id, label, logits): inner products with the class means of train, classes in order of label."""
    inner = F.transform("means", lambda m: F.aggregate(F.zip_with("vec", m, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return test.crossJoin(F.broadcast(class_means(train))).select("sample_id", "label", inner.alias("logits"))
