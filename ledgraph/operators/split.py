"""Time-based train/test split."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TemporalSplit:
    """Train: time up to train_max. Test: from test_min, up to test_max if there is one. Any orderable values of one type."""

    train_max: Any
    test_min: Any
    test_max: Any = None
    time_attr: str = "time_step"

    def __post_init__(self) -> None:
        if self.test_min <= self.train_max:
            raise ValueError(f"test begins at {self.test_min}, not after train ends at {self.train_max}")
        if self.test_max is not None and self.test_max < self.test_min:
            raise ValueError(f"test ends at {self.test_max}, before it begins at {self.test_min}")

    @property
    def test_window(self) -> str:
        return f"{self.test_min}-{'end' if self.test_max is None else self.test_max}"

    def in_train(self) -> Column:
        """Never null: a null time is in neither part."""
        return F.coalesce(F.col(self.time_attr) <= F.lit(self.train_max), F.lit(False))

    def in_test(self) -> Column:
        t = F.col(self.time_attr)
        inside = t >= F.lit(self.test_min)
        if self.test_max is not None:
            inside &= t <= F.lit(self.test_max)
        return F.coalesce(inside, F.lit(False))


def split_masks(nodes: DataFrame, split: TemporalSplit) -> DataFrame:
    """``nodes`` and train_mask, test_mask; times in the gap or after the test window are in neither."""
    return nodes.withColumns({"train_mask": split.in_train(), "test_mask": split.in_test()})


def labelled_split(nodes: DataFrame, split: TemporalSplit) -> DataFrame:
    """Labelled nodes of either part, with column split ('train' or 'test')."""
    part = F.when(split.in_train(), "train").when(split.in_test(), "test")
    return nodes.filter(F.col("y") != -1).withColumn("split", part).filter(F.col("split").isNotNull())


def support_counts(parts: DataFrame) -> DataFrame:
    """One row: n_train, n_test, n_test_illicit (positives of the test part)."""
    test = F.col("split") == "test"
    return parts.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(test).alias("n_test"), F.count_if(test & (F.col("y") == 1)).alias("n_test_illicit"))


def local_features(nodes: DataFrame, n: int = 94) -> DataFrame:
    """``nodes`` with the first ``n`` features only."""
    return nodes.withColumn("features", F.slice("features", 1, n))
