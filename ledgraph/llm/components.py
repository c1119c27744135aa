"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least node of its component, given links that fit in memory."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(old, label):
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


#: Links that a task of a round takes at least, where there are as many for every core.
ROWS = 500_000


def components(links: DataFrame) -> DataFrame:
    """node, label: for each node of the links (a, b), the least node of its component.

    Every round rewires links to the least neighbour (first of the larger, then of the smaller neighbours), which ends
    with one star per component after a number of rounds that grows as the logarithm of its size. The least neighbour is
    an aggregate, written before it is joined back, so a hub with many links is a skewed join key against one row, which
    adaptive execution splits, and no collected group. Each round is written to the shared folder, by as many tasks as its
    links need, whatever number of partitions is set. Links of a node to itself are ignored.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    rows, before = edges.count(), None
    while True:
        tasks = max(links.sparkSession.sparkContext.defaultParallelism, rows // ROWS)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")).coalesce(tasks), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large.coalesce(tasks), "links")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stored(small.filter("a <> b").distinct().coalesce(tasks), "links")
        seen = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        rows, before = seen[0], seen
