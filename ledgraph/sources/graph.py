"""Readers of the three graph tables: node features, classes, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, edges, nodes
from .store import bucketed, stored


def fold_features(df: DataFrame, id_type: str = "long") -> DataFrame:
    """Columns by position: id, time step, then every other column as one FLOAT array; id and time are no features."""
    key, time, *rest = df.columns
    features = F.array(*[F.col(f"`{c}`").cast("float") for c in rest]) if rest else F.array().cast("array<float>")
    return df.select(F.col(f"`{key}`").cast(id_type).alias("tx_id"), F.col(f"`{time}`").cast("int").alias("time_step"), features.alias("features"))


def read_node_features(spark: SparkSession, path: str, id_type: str = "long", format: str = "csv") -> DataFrame:
    """tx_id, time_step, features from a CSV without header, or from Parquet with columns in the same order."""
    raw = spark.read.csv(path, header=False, inferSchema=False) if format == "csv" else spark.read.format(format).load(path)
    return fold_features(raw, id_type)


def _two_columns(spark: SparkSession, path: str, schema: str, format: str) -> DataFrame:
    if format == "csv":
        return spark.read.csv(path, header=True, schema=schema)
    raw = spark.read.format(format).load(path)
    first, second = (x.split() for x in schema.split(", "))
    return raw.select(F.col(raw.columns[0]).cast(first[1]).alias(first[0]), F.col(raw.columns[1]).cast(second[1]).alias(second[0]))


def read_classes(spark: SparkSession, path: str, id_type: str = "long", format: str = "csv") -> DataFrame:
    """tx_id and class (text, as it stands) by position; the CSV has a header."""
    return _two_columns(spark, path, f"tx_id {id_type}, class string", format)


def read_edges(spark: SparkSession, path: str, id_type: str = "long", format: str = "csv") -> DataFrame:
    """src and dst by position; the CSV has a header."""
    return _two_columns(spark, path, f"src {id_type}, dst {id_type}", format)


def load_graph(
    spark: SparkSession, features: str, classes: str, edge_list: str, symmetrise: bool = True, strict: dict | None = None, format: str = "csv"
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes with label y and flag labelled, unknown ones too; edges checked and, by default, symmetrised.

    ``strict`` holds the expected n_nodes, n_steps, max_step and n_features of ``checks.assert_canonical``.

    Each file is read once: nodes become a table bucketed by tx_id (their features are shuffled then, and in no later join
    on it), edges a table of two columns. Dimensions are observed while nodes are written; only the distinct time steps
    and the edges' ends are read again, as columns of these tables.
    """
    seen = Observation()
    read = checks.observed(read_node_features(spark, features, format=format), seen)
    held = bucketed(read, "tx_id", "graph_nodes")
    n = nodes.attach_labels(held, read_classes(spark, classes, format=format))
    e = stored(read_edges(spark, edge_list, format=format), "graph-edges")
    if strict is not None:
        checks.assert_observed(seen, held, **strict)
    edges.assert_no_dangling(e, held)
    return n, edges.symmetrise_edges(e) if symmetrise else e
