"""Graphs made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.nodes import encode_label, labelled_mask
from ..operators.split import TemporalSplit

MONTHS = TemporalSplit(55, 56, 80)
#: Deterministic stand-ins for scores: name and multiplier.
SCORERS = (("mod_a", 7919), ("mod_b", 104729))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id and time_step, the month of an order counted from 1995-01."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), month.cast("int").alias("time_step"))


def order_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.when(s == "F", "1").when(s == "O", "2").otherwise("unknown").alias("class"))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, time_step, y, labelled, features: the total price, and of the lineitems the count, quantities, prices and mean discount."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"))
    )
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    s = F.col("o_orderstatus")
    y = encode_label(F.when(s == "F", "1").when(s == "O", "2").otherwise("unknown"))
    values = [F.col("o_totalprice")] + [F.coalesce(F.col(c), F.lit(0)) for c in ("n", "q", "p", "d")]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice").join(lines, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("tx_id"), month.cast("int").alias("time_step"), y.alias("y"), labelled_mask(y).alias("labelled"), F.array(*[v.cast("double") for v in values]).alias("features"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order to the same customer's next."""
    own = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    after = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(own).alias("dst"))
    return after.filter("dst IS NOT NULL")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part of every lineitem in one id space: repeats, self-loops, pairs in both directions, hubs."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """baseline, seed, tx_id, y, score, pred over the labelled test orders, for two stand-in scorers and three seeds."""
    runs = F.array(*[F.struct(F.lit(b).alias("baseline"), F.lit(m).alias("mult"), F.lit(s).alias("seed")) for b, m in SCORERS for s in range(3)])
    s = F.col("o_orderstatus")
    y = encode_label(F.when(s == "F", "1").when(s == "O", "2").otherwise("unknown"))
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), month.alias("time_step"), y.alias("y"))
    each = rows.filter(MONTHS.in_test() & labelled_mask(F.col("y"))).select("tx_id", "y", F.explode(runs).alias("r"))
    score = F.pmod(F.col("tx_id") * F.col("r.mult") + F.col("r.seed") * 31, F.lit(1009)) / F.lit(1009.0)
    return each.select("r.baseline", "r.seed", "tx_id", "y", score.alias("score"), (score > 0.5).cast("int").alias("pred"))
