"""The strictly inductive training subgraph and its leakage guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .hubs import join_end
from .split import TemporalSplit


def edge_endpoint_times(edges: DataFrame, nodes: DataFrame, time_attr: str = "time_step", hub_rows: int | None = None) -> DataFrame:
    """src, dst, src_time, dst_time of every edge; null where an end is no node. Only ids and times are joined. ``hub_rows``: see ``hubs.join_end``."""
    times = nodes.select("tx_id", time_attr)
    src = times.select(F.col("tx_id").alias("src"), F.col(time_attr).alias("src_time"))
    dst = times.select(F.col("tx_id").alias("dst"), F.col(time_attr).alias("dst_time"))
    found = join_end(join_end(edges, src, "src", "left", hub_rows), dst, "dst", "left", hub_rows)
    return found.select("src", "dst", "src_time", "dst_time")


def _late(time: str, split: TemporalSplit) -> Column:
    """Later than train_max, or without a time."""
    return F.coalesce(F.col(time) > F.lit(split.train_max), F.lit(True))


def train_nodes(nodes: DataFrame, split: TemporalSplit) -> DataFrame:
    return nodes.withColumn("train_mask", split.in_train())


def induced_train_subgraph(edges: DataFrame, nodes: DataFrame, split: TemporalSplit, hub_rows: int | None = None) -> DataFrame:
    """Edges with both ends in train; repeats and self-loops stay, ids stay. The test bounds play no part. ``hub_rows``: see ``hubs.join_end``."""
    ids = nodes.filter(split.in_train()).select("tx_id")
    inside = join_end(edges, ids.withColumnRenamed("tx_id", "src"), "src", "left_semi", hub_rows)
    return join_end(inside, ids.withColumnRenamed("tx_id", "dst"), "dst", "left_semi", hub_rows).select("src", "dst")


def induced_and_leakage(edges: DataFrame, nodes: DataFrame, split: TemporalSplit, hub_rows: int | None = None) -> tuple[DataFrame, Observation]:
    """The edges of ``induced_train_subgraph`` and, once an action has run on them, the counts of ``leakage_report`` on ``edges``: n_edges, n_leaking.

    One join of ends with times serves both; the counts are observed on the way. Node ids have to be unique.
    """
    seen, leaks = Observation(), _late("src_time", split) | _late("dst_time", split)
    times = edge_endpoint_times(edges, nodes, split.time_attr, hub_rows).withColumn("leaks", leaks)
    watched = times.observe(seen, F.count("*").alias("n_edges"), F.count_if("leaks").alias("n_leaking"))
    return watched.filter("NOT leaks").select("src", "dst"), seen


def leakage_report(edges: DataFrame, nodes: DataFrame, split: TemporalSplit) -> DataFrame:
    """One row: n_edges, n_leaking. An edge leaks, once, if either end is later than train_max, has no time or is no node."""
    leaks = _late("src_time", split) | _late("dst_time", split)
    return edge_endpoint_times(edges, nodes, split.time_attr).agg(F.count("*").alias("n_edges"), F.count_if(leaks).alias("n_leaking"))


def assert_no_leakage(edges: DataFrame, nodes: DataFrame, split: TemporalSplit) -> None:
    n = leakage_report(edges, nodes, split).first()["n_leaking"]
    if n:
        raise AssertionError(f"{n} edges reach past {split.train_max}")
