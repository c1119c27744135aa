"""Class weights, train-only standardisation, and the two classifiers without a graph."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import dropped, stored
from . import forest

BASELINES = ("rf", "lr")


def class_weights(train: DataFrame) -> DataFrame:
    """y, n, weight: rows / (classes * rows of the class)."""
    everything = W.partitionBy()  # one row per class
    return train.groupBy("y").agg(F.count("*").alias("n")).withColumn("weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))


def scaler_stats(train: DataFrame) -> DataFrame:
    """One row: mean and scale, arrays over the features, from one pass. scale is the population deviation, 1 where it is 0."""
    s = train.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col("features").cast("array<double>"))).alias("s"))
    n = F.col("s.count")
    mean, var = vector_to_array("s.mean"), vector_to_array("s.variance")
    scale = F.transform(var, lambda v: F.when(v * (n - 1) / n > 0, F.sqrt(v * (n - 1) / n)).otherwise(1.0))
    return s.select(mean.alias("mean"), scale.alias("scale"))


def standardise(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with features (x - mean) / scale, as DOUBLE; ``stats`` is the one row of ``scaler_stats``."""
    row = stats.first()
    if row["mean"] is None:
        return df.withColumn("features", F.col("features").cast("array<double>"))
    mean, scale = (F.array(*[F.lit(float(v)) for v in row[k]]) for k in ("mean", "scale"))
    return df.withColumn("features", F.transform("features", lambda x, i: (x.cast("double") - F.get(mean, i)) / F.get(scale, i)))


def _parts(parts: DataFrame, key: str, written: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """Train and test of ``parts``, written once if they aren't yet, and of each class (weight, rows). ValueError if train has not both classes."""
    parts = parts if written else stored(parts.select(key, "features", "y", "split"), "floor-parts")
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    weights = {r["y"]: (r["weight"], r["n"]) for r in class_weights(train).collect()}  # one row per class
    if set(weights) != {0, 1}:
        raise ValueError(f"train needs both classes; it has {sorted(weights)}")
    return train, test, weights


def _weight(weights: dict) -> Column:
    return F.when(F.col("y") == 1, weights[1][0]).otherwise(weights[0][0])


_VECTOR = "features_as_vector"


def _logistic(train: DataFrame, weights: dict, max_iter: int) -> list[float]:
    """Coefficients, the intercept last, of standardised ``train``: L2 penalty of 1 on all but the intercept, the loss summed over weighted rows."""
    rows = train.select(_vector().alias(_VECTOR), F.col("y").cast("double").alias("label"), _weight(weights).alias("w"))
    penalty = 1.0 / sum(n for _, n in weights.values())
    model = LogisticRegression(featuresCol=_VECTOR, labelCol="label", weightCol="w", maxIter=max_iter, regParam=penalty, elasticNetParam=0.0, standardization=False, tol=1e-9).fit(rows)
    return [float(x) for x in model.coefficients] + [float(model.intercept)]


def _margin(w: list[float]) -> Column:
    """The linear part of the model, from features and coefficients of which the last is the intercept."""
    products = F.zip_with("features", F.array(*map(F.lit, w[:-1])), lambda a, b: a * b)
    return F.aggregate(products, F.lit(w[-1]), lambda a, b: a + b)


def _vector() -> Column:
    return array_to_vector(F.col("features").cast("array<double>"))


def fit_predict(
    parts: DataFrame, baseline: str, seed: int = 0, num_trees: int = 300, max_depth: int | None = None, max_iter: int = 2000, key: str = "tx_id", tree_rows: int | None = None, written: bool = False
) -> DataFrame:
    """key, y, score (probability of the positive class), pred of the test part, fitted on the train part.

    ``parts`` has features, y (0 or 1) and split. Classes are weighted evenly. 'rf': a forest of trees of any depth on the
    features as they are; 'lr': logistic regression with an L2 penalty of 1 on train-standardised features. Time is no
    feature. ValueError for another name, or if train has not both classes. A score of one half is no positive.

    ``parts`` is written once (unless it is ``written``, a table already) and read for the weights, the scaler, the fit and
    the prediction. Trees are grown in tasks
    (``forest``), each on a bootstrap of all train rows up to ``tree_rows`` different ones (None: what a task can hold) and
    of a random part of them beyond.
    """
    if baseline not in BASELINES:
        raise ValueError(f"no baseline {baseline!r}; there are {BASELINES}")
    train, test, weights = _parts(parts, key, written)
    if baseline == "rf":
        model = forest.fit(train, (weights[0][0], weights[1][0]), seed, num_trees, max_depth, tree_rows)
        scored = forest.predict(model, test.select(F.col(key).alias("key"), "features", "y"))
        dropped(model["trees"])  # all votes are written
        return scored.select(F.col("key").alias(key), "y", "score", (F.col("score") > 0.5).cast("int").alias("pred"))
    stats = scaler_stats(train)
    margin = _margin(_logistic(standardise(train, stats), weights, max_iter))
    return standardise(test, stats).select(key, "y", (1 / (1 + F.exp(-margin))).alias("score"), (margin > 0).cast("int").alias("pred"))


def logistic_gradient(parts: DataFrame, max_iter: int = 2000, key: str = "tx_id") -> DataFrame:
    """coefficient (the feature's place, the intercept last), value, gradient: of the objective of 'lr' at the fitted coefficients, over all train rows, divided by their weight.

    The objective is strictly convex, so a gradient of 0 says that the fit is its only optimum, without another fit to
    compare with. One pass of sums.
    """
    train, _, weights = _parts(parts, key)
    train = standardise(train, scaler_stats(train))
    w = _logistic(train, weights, max_iter)
    n, total = len(w) - 1, sum(weight * rows for weight, rows in weights.values())
    x = F.concat("features", F.array(F.lit(1.0)))
    error = _weight(weights) * (1 / (1 + F.exp(-_margin(w))) - F.col("y"))
    row = train.select(x.alias("x"), error.alias("e")).agg(*[F.sum(F.col("e") * F.col("x")[i]).alias(f"g{i}") for i in range(n + 1)])
    penalty = [*w[:n], 0.0]
    each = F.array(*[F.struct(F.lit(i).alias("coefficient"), F.lit(w[i]).alias("value"), ((F.col(f"g{i}") + penalty[i]) / total).alias("gradient")) for i in range(n + 1)])
    return row.select(F.inline(each))
