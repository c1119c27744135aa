"""Joins of edges with nodes that split ids of very many edges (hubs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of an id from which it counts as a hub.
HUB_ROWS = 1_000_000
#: No more ids than this are hubs: each holds more than this part of all edges.
HUBS = 1_000


def hub_ids(edges: DataFrame, end: str, hub_rows: int = HUB_ROWS) -> DataFrame | None:
    """_hub, _salts of the hubs among the ids at ``end``, the null id too; None if there are none.

    A hub has more than ``hub_rows`` edges and more than one in HUBS of all, so fewer than HUBS rows come back whatever the
    table. Its edges are dealt to ``salts`` parts of about that size. Counts are combined before the shuffle.
    """
    counts = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    part = max(hub_rows, -(-(total or 0) // HUBS))
    if (most or 0) <= part:
        return None
    found = counts.filter(F.col("n") > part).select("id", F.ceil(F.col("n") / part).cast("int").alias("salts")).collect()
    kind = edges.schema[end].dataType.simpleString()
    return edges.sparkSession.createDataFrame([tuple(r) for r in found], f"_hub {kind}, _salts int")


def join_end(edges: DataFrame, nodes: DataFrame, end: str, how: str = "inner", hub_rows: int | None = None) -> DataFrame:
    """``edges`` joined with ``nodes`` on the column ``end``, which both have; nodes are unique in it.

    With ``hub_rows``, hubs are looked for first: their edges are dealt to parts in turn, and the hub's row of ``nodes``
    goes to each part. Null ends, which match nothing, are dealt out likewise. Without, it is a plain join.
    """
    found = None if hub_rows is None else hub_ids(edges, end, hub_rows)
    if found is None:
        return edges.join(nodes, end, how)
    hubs = F.broadcast(found)  # fewer than HUBS rows
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int"))
    left = edges.join(hubs, F.col(end).eqNullSafe(F.col("_hub")), "left").withColumn("_salt", salt).drop("_hub", "_salts")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    right = nodes.join(hubs, F.col(end) == F.col("_hub"), "left").withColumn("_salt", salts).drop("_hub", "_salts")
    return left.join(right, [end, "_salt"], how).drop("_salt")
