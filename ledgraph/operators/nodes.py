"""Node tables: labels and dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stored

POSITIVE, NEGATIVE, UNKNOWN = 1, 0, -1


def encode_label(text: Column) -> Column:
    """'1' is positive (1), '2' negative (0), anything else and null unknown (-1)."""
    return F.when(text == "1", POSITIVE).when(text == "2", NEGATIVE).otherwise(UNKNOWN)


def labelled_mask(y: Column) -> Column:
    return y != UNKNOWN


def unique_classes(classes: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per tx_id: the last by ``order_col``; without one, repeated ids raise ValueError."""
    if order_col is not None:
        return classes.groupBy("tx_id").agg(F.max_by("class", order_col).alias("class"))
    twice = classes.groupBy("tx_id").count().filter("count > 1").select("tx_id").take(1)
    if twice:
        raise ValueError(f"several classes for tx_id {twice[0][0]}; name a column that orders them")
    return classes


def attach_labels(nodes: DataFrame, classes: DataFrame, order_col: str | None = None) -> DataFrame:
    """``nodes`` and y, labelled. Nodes without a class are unknown; classes of unknown ids don't matter.

    From nodes that ``store.bucketed`` has written by tx_id, only classes are shuffled; features stay where they are.
    """
    known = unique_classes(classes, order_col).select("tx_id", encode_label(F.col("class")).alias("y"))
    return nodes.join(known, "tx_id", "left").withColumn("y", F.coalesce("y", F.lit(UNKNOWN))).withColumn("labelled", labelled_mask(F.col("y")))


def label_profile(nodes: DataFrame, *by: str) -> DataFrame:
    """Rows per label, and per ``by`` columns if given."""
    return nodes.groupBy(*by, "y").agg(F.count("*").alias("n"))


def assign_node_index(nodes: DataFrame, key: str = "tx_id", order_col: str | None = None) -> DataFrame:
    """key and node_idx, dense from 0 in the order of ``order_col`` (the key by default), without a global sort in one task.

    Rows are range-partitioned and numbered within partitions; partitions' sizes, one row each, give the offsets. If a
    key has several rows its last place is its index, and every row still counts.
    """
    order = order_col or key
    cols = [key] if order == key else [key, order]
    part = nodes.select(*cols).repartitionByRange(F.col(order)).sortWithinPartitions(order, key)
    mark = F.monotonically_increasing_id()
    placed = stored(part.select(key, F.shiftright(mark, 33).alias("_part"), mark.bitwiseAND((1 << 33) - 1).alias("_place")), "node-index")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").groupBy(key).agg(F.max(F.col("_place") + F.col("_before")).alias("node_idx"))
