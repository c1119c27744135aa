"""Metrics of the positive class."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stored


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion_counts(scored: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn from y and pred, per ``by`` columns if given."""
    hit, said = F.col("y") == 1, F.col("pred") == 1
    return scored.groupBy(*by).agg(F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"), F.count_if(hit & ~said).alias("fn"), F.count_if(~hit & ~said).alias("tn"))


def counts_to_metrics(counts: DataFrame, *by: str) -> DataFrame:
    """illicit_f1, illicit_recall, illicit_precision; 0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, _ratio(2 * tp, 2 * tp + fp + fn).alias("illicit_f1"), _ratio(tp, tp + fn).alias("illicit_recall"), _ratio(tp, tp + fp).alias("illicit_precision"))


def floor_metrics(scored: DataFrame, *by: str) -> DataFrame:
    return counts_to_metrics(confusion_counts(scored, *by), *by)


def roc_auc(scored: DataFrame) -> float | None:
    """Exact area under the ROC curve of all rows; ties count one half. None with one class only."""
    if scored.agg(F.countDistinct("y")).first()[0] < 2:
        return None
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(scored.select("score", F.col("y").cast("double").alias("y")))


#: Distinct scores up to which a group's are summed by one window.
WINDOW_SCORES = 1_000_000


def roc_auc_by(scored: DataFrame, *by: str, window_scores: int = WINDOW_SCORES) -> DataFrame:
    """illicit_auc per ``by`` columns, from counts per distinct score; null with one class only.

    The negatives below a score are a running sum in a group. Beyond ``window_scores`` distinct scores, rows are
    range-partitioned by group and score, summed within each part, and a second window over a group's parts, one row
    each, adds what earlier parts hold; so a group of any size is spread.
    """
    each = stored(scored.groupBy(*by, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")), "scores")
    part = F.lit(0)
    if each.count() > window_scores:
        each = stored(each.repartitionByRange(*by, "score").withColumn("_part", F.spark_partition_id()), "scores")
        part = F.col("_part")
    inside = W.partitionBy(*by, "_part").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    ranked = each.withColumn("_part", part).withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    parts = ranked.groupBy(*by, "_part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), area.alias("area"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    total = F.sum("pos") * F.sum("neg")
    return parts.groupBy(*by).agg(F.when(total > 0, F.sum(F.col("area") + F.col("pos") * F.col("below")) / total).alias("illicit_auc"))
