"""Edge tables: checks, ids, both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .hubs import join_end


def remap_edges(edges: DataFrame, index: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """src_idx and dst_idx of every edge whose two ends are in ``index`` (tx_id, node_idx). ``hub_rows``: see ``hubs.join_end``."""
    src = index.select(F.col("tx_id").alias("src"), F.col("node_idx").alias("src_idx"))
    dst = index.select(F.col("tx_id").alias("dst"), F.col("node_idx").alias("dst_idx"))
    return join_end(join_end(edges, src, "src", hub_rows=hub_rows), dst, "dst", hub_rows=hub_rows).select("src_idx", "dst_idx")


def dangling_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct endpoint ids that are no node; a null id is dangling. Endpoints are made distinct before the join."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("tx_id")).distinct()
    return ends.join(nodes.select("tx_id"), "tx_id", "left_anti")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, each once, repeated rows kept.

    Distinct ends are reduced to those that are no nodes, and written; edges are then matched with these only. As the
    table is written, Spark knows its size: a small one is broadcast, and edges aren't shuffled at all.
    """
    bad = stored(dangling_endpoints(edges, nodes).filter("tx_id IS NOT NULL"), "dangling")
    src, dst = (bad.select(F.col("tx_id").alias(c), F.lit(True).alias(f"_{c}")) for c in ("src", "dst"))
    found = edges.join(src, "src", "left").join(dst, "dst", "left")
    return found.filter("_src OR _dst OR src IS NULL OR dst IS NULL").select("src", "dst")


def assert_no_dangling(edges: DataFrame, nodes: DataFrame) -> None:
    n = dangling_endpoints(edges, nodes).count()
    if n:
        raise ValueError(f"{n} edge endpoints are no nodes")


def symmetrise_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once; a self-loop once.

    Pairs are ordered and made distinct before they are doubled, so only the input's rows are shuffled.
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")))).otherwise(
        F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    )
    return pairs.select(F.inline(both))
