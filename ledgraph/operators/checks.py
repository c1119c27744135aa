"""Dataset dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def dataset_profile(nodes: DataFrame) -> DataFrame:
    """One row, from one pass: n_nodes, n_steps, max_step, min_features, max_features."""
    size = F.size("features")
    return nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("time_step").alias("n_steps"), F.max("time_step").alias("max_step"), F.min(size).alias("min_features"), F.max(size).alias("max_features"))


def observed(nodes: DataFrame, seen: Observation) -> DataFrame:
    """``nodes``, whose dimensions but the number of steps are counted into ``seen`` by the first action on it."""
    size = F.size("features")
    return nodes.observe(seen, F.count(F.lit(1)).alias("n_nodes"), F.max("time_step").alias("max_step"), F.min(size).alias("min_features"), F.max(size).alias("max_features"))


def _assert_same(found: dict, n_nodes: int, n_steps: int, max_step: int, n_features: int) -> None:
    want = {"n_nodes": n_nodes, "n_steps": n_steps, "max_step": max_step, "min_features": n_features, "max_features": n_features}
    wrong = [f"{k} is {found[k]}, not {v}" for k, v in want.items() if found[k] != v]
    if wrong:
        raise AssertionError("; ".join(wrong))


def assert_canonical(nodes: DataFrame, n_nodes: int = 203_769, n_steps: int = 49, max_step: int = 49, n_features: int = 165) -> None:
    """Raises AssertionError with every dimension that differs."""
    _assert_same(dataset_profile(nodes).first().asDict(), n_nodes, n_steps, max_step, n_features)


def assert_observed(seen: Observation, nodes: DataFrame, n_nodes: int = 203_769, n_steps: int = 49, max_step: int = 49, n_features: int = 165) -> None:
    """As ``assert_canonical``, from what ``observed`` has counted; of the written ``nodes`` only the time steps are read."""
    steps = nodes.agg(F.countDistinct("time_step")).first()[0]
    _assert_same(seen.get | {"n_steps": steps}, n_nodes, n_steps, max_step, n_features)
