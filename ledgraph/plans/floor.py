"""Fit, score, evaluate and log the classifiers without a graph."""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..functions.scalar import canonical_json, config_hash
from ..operators import metrics
from ..operators.models import BASELINES, fit_predict
from ..operators.split import TemporalSplit, labelled_split, support_counts
from ..sources.runlog import RUN_LOG, append_runs
from ..sources.store import stored

SEEDS = (0, 1, 2)
#: Baselines whose fit no seed changes.
SEEDLESS = ("lr",)


def evaluate(scored: DataFrame) -> dict[str, float | None]:
    scored = stored(scored.select("y", "score", "pred"), "floor-scored")
    row = metrics.floor_metrics(scored).first()
    found = row.asDict() if row else {"illicit_f1": 0.0, "illicit_recall": 0.0, "illicit_precision": 0.0}
    return found | {"illicit_auc": metrics.roc_auc(scored)}


def run_floor(
    parts: DataFrame, split: TemporalSplit, baseline: str, seed: int, log_path: str | None, base_config: dict | None = None, write_on_error: bool = True, done: dict | None = None, **how
) -> dict:
    """One run: the row that it adds to the log at ``log_path`` (None: it isn't written).

    The row is written even if the fit raises, with ERRORED in its notes, unless ``write_on_error`` is off; the error is
    raised on. ``done`` are the metrics of a run that differs in its seed only, for a baseline that doesn't use it.
    """
    config = (base_config or {}) | {"baseline": baseline, "seed": seed}
    row = {
        "timestamp_utc": datetime.now(UTC).isoformat(),
        "run_id": f"{config.get('model', 'floor')}-{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}",
        "model": config.get("model", "floor"),
        "phase": config.get("phase"),
        "config_hash": config_hash(config),
        "git_commit": config.get("git_commit"),
        "git_dirty": config.get("git_dirty"),
        "seed": seed,
        "data_snapshot_id": config.get("data_snapshot_id"),
        "notes": f"tabular floor: {baseline}",
    }
    began, failed, found = time.monotonic(), True, {}
    try:
        if done is None:
            support = support_counts(parts).first().asDict()
            done = {"baseline": baseline, "test_window": split.test_window} | support | evaluate(fit_predict(parts, baseline, seed, **how))
        found = done
        failed = False
    finally:
        row |= {"metrics_json": canonical_json(found), "wall_clock_s": round(time.monotonic() - began, 6)}
        if failed:
            row["notes"] += " ERRORED"
        if log_path is not None and (write_on_error or not failed):
            append_runs(parts.sparkSession.createDataFrame([tuple(row.get(c) for c in RUN_LOG.names)], RUN_LOG), log_path)
    return row


def run_floor_grid(
    nodes: DataFrame, split: TemporalSplit, log_path: str, baselines: tuple[str, ...] = BASELINES, seeds: tuple[int, ...] = SEEDS, base_config: dict | None = None, **how
) -> list[str]:
    """All baselines with all seeds over one split, written once; the rows go to the log in one append. Returns the run ids.

    A baseline without randomness is fitted once; its metrics are logged for every seed, each with its own config hash.
    """
    parts = stored(labelled_split(nodes, split), "floor-grid")
    rows = []
    try:
        for b in baselines:
            done = None
            for s in seeds:
                rows.append(run_floor(parts, split, b, s, None, base_config, done=done, written=True, **how))
                done = json.loads(rows[-1]["metrics_json"]) if b in SEEDLESS else None
    finally:
        if rows:
            append_runs(nodes.sparkSession.createDataFrame([tuple(r.get(c) for c in RUN_LOG.names) for r in rows], RUN_LOG), log_path)
    return [r["run_id"] for r in rows]
