"""Per-seed and mean ± deviation tables from the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import format_mean_std, parse_metrics

SHOWN = {"f1": "illicit_f1", "recall": "illicit_recall", "auc": "illicit_auc"}


def parsed(log: DataFrame) -> DataFrame:
    """run_id, seed and the fields of metrics_json."""
    return log.select("run_id", F.col("seed").cast("int").alias("seed"), parse_metrics(F.col("metrics_json")).alias("m")).select("run_id", "seed", "m.*")


def seed_summary(log: DataFrame) -> DataFrame:
    """Per baseline: runs, mean and population deviation of f1, recall and auc; null over no values."""
    cols = [f(c).alias(f"{k}_{name}") for k, c in SHOWN.items() for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return parsed(log).groupBy("baseline").agg(F.count("*").alias("runs"), *cols)


def gate_table(log: DataFrame) -> DataFrame:
    """Text rows of the report: each baseline's seeds in order, then 'mean ± std'; position orders the rows of a baseline."""
    seeds = parsed(log).select(
        "baseline", F.col("seed").cast("long").alias("position"), F.col("seed").cast("string").alias("row"), *[F.format_string("%.4f", c).alias(k) for k, c in SHOWN.items()]
    )
    total = seed_summary(log).select(
        "baseline", F.lit(2**31).cast("long").alias("position"), F.lit("mean ± std").alias("row"), *[format_mean_std(F.col(f"{k}_mean"), F.col(f"{k}_std")).alias(k) for k in SHOWN]
    )
    return seeds.unionByName(total)


def provenance(log: DataFrame) -> dict:
    """The one git_commit and data_snapshot_id of the log; ValueError if there are several."""
    found = log.agg(F.collect_set("git_commit").alias("git_commit"), F.collect_set("data_snapshot_id").alias("data_snapshot_id")).first().asDict()
    several = {k: v for k, v in found.items() if len(v) > 1}
    if several:
        raise ValueError(f"runs of several origins: {several}")
    return {k: next(iter(v), None) for k, v in found.items()}


def write_gate_report(log: DataFrame, path: str) -> str:
    """Writes ``gate_table`` under ``path`` and returns the report as text: a block per baseline with its seeds and run ids; the verdict stays blank."""
    table = gate_table(log)
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a few rows
    origin = provenance(log)
    support = parsed(log).select("n_train", "n_test", "n_test_illicit", "test_window").distinct().collect()
    lines = [f"commit {origin['git_commit']}, data {origin['data_snapshot_id']}"]
    lines += [f"train {r.n_train}, test {r.n_test} ({r.n_test_illicit} positive), steps {r.test_window}" for r in support]
    rows = table.orderBy("baseline", "position").collect()
    runs = parsed(log).select("baseline", "run_id").orderBy("baseline", "run_id").collect()
    for name in dict.fromkeys(r.baseline for r in rows):
        lines += ["", "| baseline | seed | F1 | recall | AUC |", "| --- | --- | --- | --- | --- |"]
        lines += [f"| {r.baseline} | {r.row} | {r.f1} | {r.recall} | {r.auc} |" for r in rows if r.baseline == name]
        lines += ["", f"runs of {name}: " + ", ".join(r.run_id for r in runs if r.baseline == name)]
    lines += ["", "runs: " + ", ".join(sorted(r.run_id for r in runs)), "verdict: "]
    return "\n".join(lines)
