"""Metrics, models, run log and report."""

import json
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgraph.functions import scalar
from ledgraph.operators import forest, metrics, models, split
from ledgraph.plans import floor, report
from ledgraph.sources import runlog
from ledgraph.sources.store import stored

SPLIT = split.TemporalSplit(34, 35, 49)


@pytest.fixture(scope="module")
def separable(spark):
    rows, i = [], 0
    for t in (5, 12, 20, 30, 36, 40, 45):
        for x, y in ((2.0, 1), (-2.0, 0)):
            rows.append((i, [x, x], y, t, True))
            i += 1
    rows += [(i, [0.0, 0.0], -1, 10, False), (i + 1, [0.0, 0.0], -1, 42, False)]
    return spark.createDataFrame(rows, "tx_id long, features array<float>, y int, time_step int, labelled boolean")


def test_support(separable):
    assert tuple(split.support_counts(split.labelled_split(separable, SPLIT)).first()) == (8, 6, 3)


@pytest.mark.parametrize("baseline", models.BASELINES)
def test_separable(separable, baseline):
    scored = models.fit_predict(split.labelled_split(separable, SPLIT), baseline, num_trees=10, max_depth=3)
    assert floor.evaluate(scored) == {"illicit_f1": 1.0, "illicit_recall": 1.0, "illicit_precision": 1.0, "illicit_auc": 1.0}


def test_models_refuse(separable):
    parts = split.labelled_split(separable, SPLIT)
    with pytest.raises(ValueError, match="no baseline"):
        models.fit_predict(parts, "svm")
    with pytest.raises(ValueError, match="both classes"):
        models.fit_predict(parts.filter("y = 1"), "lr")


@pytest.mark.parametrize(
    ("tp", "fp", "fn", "f1", "recall", "precision"),
    [
        (781, 71, 302, 0.807235142118863, 0.7211449676823638, 0.9166666666666666),
        (780, 81, 303, 0.8024691358024691, 0.7202216066481995, 0.9059233449477352),
        (786, 77, 297, 0.8078108941418294, 0.7257617728531855, 0.9107763615295481),
        (948, 4241, 135, 0.3022959183673469, 0.8753462603878116, 0.18269416072460976),
        (0, 0, 0, 0.0, 0.0, 0.0),
    ],
)
def test_metrics_of_counts(spark, tp, fp, fn, f1, recall, precision):
    row = metrics.counts_to_metrics(spark.createDataFrame([(tp, fp, fn)], "tp long, fp long, fn long")).first()
    assert tuple(row) == pytest.approx((f1, recall, precision), abs=1e-15)


def test_auc(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.5), ("a", 1, 0.5), ("a", 0, 0.1), ("b", 1, 0.3), ("b", 1, 0.4)]
    scored = spark.createDataFrame(rows, "k string, y int, score double")
    assert {r.k: r.illicit_auc for r in metrics.roc_auc_by(scored, "k").collect()} == {"a": 0.875, "b": None}
    assert {r.k: r.illicit_auc for r in metrics.roc_auc_by(scored, "k", window_scores=2).collect()} == {"a": 0.875, "b": None}
    assert metrics.roc_auc_by(scored.limit(0), "k").count() == 0
    assert metrics.roc_auc(scored.filter("k = 'a'")) == pytest.approx(0.875)
    assert metrics.roc_auc(scored.filter("k = 'b'")) is None
    assert metrics.roc_auc(scored.limit(0)) is None


def test_auc_by_group_against_pairs(spark):
    rows = [(k, (i * 7 + len(k)) % 3 == 0, (i * i * 13 % 41) / 10 if i % 29 else None) for k, n in (("large", 400), ("small", 9)) for i in range(n)]
    scored = spark.createDataFrame([(k, int(y), s) for k, y, s in rows], "k string, y int, score double")
    found = {r.k: r.illicit_auc for r in metrics.roc_auc_by(scored, "k").collect()}
    for k in found:
        pos, neg = ([-1.0 if s is None else s for g, y, s in rows if g == k and y == want] for want in (True, False))  # null scores come first
        assert found[k] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))


def test_scaler(spark):
    train = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<float>")
    stats = models.scaler_stats(train)
    row = stats.first()
    assert (row["mean"], row["scale"]) == ([2.0, 5.0], [1.0, 1.0])
    test = spark.createDataFrame([([4.0, 7.0],)], "features array<float>")
    assert models.standardise(test, stats).first().features == [2.0, 2.0]


def test_class_weights(spark):
    rows = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert {(r.y, r.n, round(r.weight, 6)) for r in models.class_weights(rows).collect()} == {(0, 3, 0.666667), (1, 1, 2.0)}


def test_floor_run_and_log(spark, separable, tmp_path):
    path = str(tmp_path / "log")
    ids = floor.run_floor_grid(separable, SPLIT, path, baselines=("lr",), seeds=(0, 1), base_config={"model": "m", "phase": "P", "git_commit": "c", "data_snapshot_id": "d"}, max_iter=20)
    log = runlog.read_runs(spark, path)
    assert log.count() == 2 and {r.run_id for r in log.collect()} == set(ids)
    runlog.assert_run_log(log.limit(0), log, 2)
    found = json.loads(log.filter("seed = 0").first().metrics_json)
    assert (found["n_train"], found["n_test"], found["n_test_illicit"], found["test_window"], found["illicit_f1"]) == (8, 6, 3, "35-49", 1.0)
    with pytest.raises(ValueError):
        floor.run_floor(split.labelled_split(separable, SPLIT), SPLIT, "nope", 0, path)
    again = runlog.read_runs(spark, path)
    runlog.assert_append_only(log.limit(0), again)
    assert again.filter("notes LIKE '%ERRORED'").count() == 1
    with pytest.raises(ValueError):
        floor.run_floor(split.labelled_split(separable, SPLIT), SPLIT, "nope", 0, path, write_on_error=False)
    assert runlog.read_runs(spark, path).count() == 3
    text = report.write_gate_report(again.filter("notes NOT LIKE '%ERRORED'"), str(tmp_path / "report"))
    assert "| lr | mean ± std | 1.0000 ± 0.0000 |" in text and text.endswith("verdict: ")


def test_log_contract(spark, tmp_path):
    with pytest.raises(KeyError):
        runlog.conform(spark.createDataFrame([(1,)], "wrong int"))
    rows = spark.createDataFrame([("r1", 3, '{"a":"x,y"}', 'say "hi"', True)], "run_id string, seed int, metrics_json string, notes string, git_dirty boolean")
    path = str(tmp_path / "csv")
    runlog.append_runs(rows, path, "csv")
    back = runlog.read_runs(spark, path, ["r1"], "csv").first()
    assert (back.run_id, back.seed, back.metrics_json, back.notes, back.git_dirty, back.phase) == ("r1", 3, '{"a":"x,y"}', 'say "hi"', True, None)
    assert runlog.invalid_rows(runlog.read_runs(spark, path, format="csv")).count() == 1
    with pytest.raises(AssertionError):
        runlog.assert_append_only(rows, rows.limit(0))


def test_report_has_a_block_per_baseline(spark, tmp_path):
    metrics = lambda b: json.dumps({"baseline": b, "illicit_f1": 0.5, "illicit_recall": 0.5, "illicit_auc": 0.5})
    rows = [(f"{b}-{i}", i, metrics(b), "c", "d") for b in ("rf", "lr") for i in range(2)]
    log = spark.createDataFrame(rows, "run_id string, seed int, metrics_json string, git_commit string, data_snapshot_id string")
    text = report.write_gate_report(log, str(tmp_path / "report"))
    assert text.index("| lr | 1 |") < text.index("runs of lr: lr-0, lr-1") < text.index("| rf | 0 |") < text.index("runs of rf: rf-0, rf-1")
    assert text.count("| baseline |") == 2


def test_summary_is_population_deviation(spark):
    values = [(0.807235142118863, 0.7211449676823638, 0.9396104585817158), (0.8024691358024691, 0.7202216066481995, 0.9386668673689945), (0.8078108941418294, 0.7257617728531855, 0.939811516344592)]
    rows = [(f"r{i}", i, json.dumps({"baseline": "rf", "illicit_f1": f, "illicit_recall": r, "illicit_auc": a})) for i, (f, r, a) in enumerate(values)]
    log = spark.createDataFrame(rows, "run_id string, seed int, metrics_json string")
    total = report.gate_table(log).filter("row = 'mean ± std'").first()
    assert (total.f1, total.recall, total.auc) == ("0.8058 ± 0.0024", "0.7224 ± 0.0024", "0.9394 ± 0.0005")
    assert [r.row for r in report.gate_table(log).orderBy("position").collect()] == ["0", "1", "2", "mean ± std"]


def test_reproducibility(spark):
    log = spark.createDataFrame([("h", "1"), ("h", "1"), ("g", "1"), ("g", "2")], "config_hash string, metrics_json string")
    assert {(r.config_hash, r.runs, r.reproducible) for r in runlog.reproducibility_check(log).collect()} == {("h", 2, True), ("g", 2, False)}


def test_hashes(spark):
    config = {"model": "toy", "seed": 0, "lr": 0.1, "layers": 2}
    assert scalar.config_hash(config) == scalar.config_hash(dict(reversed(config.items())))
    one = spark.createDataFrame([('{"b":1,"a":{"d":null,"c":1e-4}}',), (None,)], "t string")
    assert [r[0] for r in one.select(scalar.config_hash_json(F.col("t"))).collect()] == [scalar.config_hash({"a": {"c": 1e-4, "d": None}, "b": 1}), None]
    struct = spark.range(1).select(scalar.config_hash_struct(F.struct(F.lit(2).alias("a"), F.lit("x").alias("b")))).first()[0]
    assert struct == scalar.config_hash({"b": "x", "a": 2})


def test_cells(spark):
    row = spark.range(1).select(
        scalar.serialise(F.lit(True)), scalar.serialise(F.lit(None)), scalar.metrics_to_json(b=F.lit(1), a=F.lit(None).cast("double")), scalar.test_window(F.lit(35), F.lit(None)),
        scalar.run_id(F.lit("m"), F.timestamp_seconds(F.lit(0)), F.lit("n")), scalar.format_mean_std(F.lit(0.5), F.lit(0.25)),
    ).first()
    assert tuple(row)[:4] == ("true", "", '{"a":null,"b":1}', "35-end")
    assert row[4].startswith("m-19700101T000000Z-") and row[5] == "0.5000 ± 0.2500"


def test_registered_floors_fit_with_the_full_parameters(monkeypatch):
    from ledgraph.plans import catalog

    seen = []
    monkeypatch.setattr(catalog.b, "order_features", lambda *a: None)
    monkeypatch.setattr(catalog.split, "labelled_split", lambda *a: None)
    monkeypatch.setattr(catalog.models, "fit_predict", lambda parts, baseline, **how: seen.append((baseline, how)))
    catalog.QUERIES["rf_floor"](None, "")
    catalog.QUERIES["lr_floor"](None, "")
    assert seen == [("rf", {}), ("lr", {})]


def plain_tree(codes, y, count, weights, max_depth=None, depth=0):
    """Nested (feature, cut, left, right) or the share of class 1, by trying every cut of every feature."""
    sums = lambda at: [count[at & (y == c)].sum() * weights[c] for c in (0, 1)]
    share = lambda at: (sums(at)[0] ** 2 + sums(at)[1] ** 2) / sum(sums(at))
    zero, one = sums(y >= 0)
    found = []
    for f in range(codes.shape[1]):
        values = np.unique(codes[:, f])
        found += [(share(codes[:, f] <= a) + share(codes[:, f] > a), f, (int(a) + int(b)) // 2) for a, b in zip(values[:-1], values[1:], strict=True)]
    if zero == 0 or one == 0 or not found or depth == max_depth:
        return round(float(one / (zero + one)), 5)
    best = max(x[0] for x in found)
    _, f, cut = next(x for x in found if x[0] == best)
    left = codes[:, f] <= cut
    return f, cut, plain_tree(codes[left], y[left], count[left], weights, max_depth, depth + 1), plain_tree(codes[~left], y[~left], count[~left], weights, max_depth, depth + 1)


def nested(tree, at=0):
    if tree["feature"][at] < 0:
        return round(float(tree["p"][at]), 5)
    child = int(tree["child"][at])
    return int(tree["feature"][at]), int(tree["cut"][at]), nested(tree, child), nested(tree, child + 1)


@pytest.mark.parametrize("max_depth", [None, 3])
def test_a_tree_against_trying_every_cut(max_depth):
    rng = np.random.default_rng(1)
    for _ in range(40):
        codes = rng.integers(0, 256, (60, 1)).astype(np.uint8)  # one feature, so that every node looks at the same
        y, count = rng.integers(0, 2, 60), rng.poisson(1, 60)
        used = count > 0
        tree = forest.grow(codes, y, count, (0.7, 1.9), 1, max_depth, rng)
        assert nested(tree) == plain_tree(codes[used], y[used], count[used], (0.7, 1.9), max_depth)


def test_a_tree_tells_its_rows_apart():
    """With any features at a node, rows that differ end in pure leaves; equal rows of both classes share a leaf."""
    rng = np.random.default_rng(2)
    codes, y = rng.integers(0, 9, (500, 4)).astype(np.uint8), rng.integers(0, 2, 500)
    tree = forest.grow(codes, y, np.ones(500, int), (1.0, 1.0), 2, None, rng)
    for row, label in zip(codes, y, strict=True):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["child"][at] + (row[tree["feature"][at]] > tree["cut"][at])
        alike = y[(codes == row).all(axis=1)]
        assert tree["p"][at] == pytest.approx(alike.mean()) and (label in alike)


def test_draws_are_a_bootstrap():
    key = np.arange(200_000)
    a, b = forest.draws(key, 0, 7, 1.0), forest.draws(key, 1, 7, 1.0)
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert np.array_equal(a[::-1], forest.draws(key[::-1], 0, 7, 1.0)) and abs(forest.draws(key, 0, 7, 0.1).mean() - 0.1) < 0.005


def curved(spark, n):
    """Labels that the features explain but no line does, on rows of three features, one of them null at times."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = (np.hypot(x[:, 0], x[:, 1]) > 1.2).astype(int)
    rows = [(f"k{i}", [float(v) if j < 2 or i % 7 else None for j, v in enumerate(r)], int(c), "train" if i % 3 else "test") for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "tx_id string, features array<float>, y int, split string")


def test_forest_on_curved_classes(spark, monkeypatch):
    parts = curved(spark, 3000)
    whole = models.fit_predict(parts, "rf", seed=5, num_trees=24)
    found = floor.evaluate(whole)
    assert found["illicit_f1"] > 0.93 and found["illicit_auc"] > 0.98
    again = {r.tx_id: r.score for r in models.fit_predict(parts.repartition(7), "rf", seed=5, num_trees=24).collect()}
    assert {r.tx_id: r.score for r in whole.collect()} == again
    assert {r.tx_id: r.score for r in models.fit_predict(parts, "rf", seed=6, num_trees=24).collect()} != again
    # Trees on a part of the rows each, and a pass for each tree, give a forest of the same kind.
    monkeypatch.setattr(forest.predict, "__defaults__", (1,))
    assert {r.tx_id: round(r.score, 9) for r in models.fit_predict(parts, "rf", seed=5, num_trees=24).collect()} == {k: round(v, 9) for k, v in again.items()}
    small = floor.evaluate(models.fit_predict(parts, "rf", seed=5, num_trees=24, tree_rows=400))
    assert small["illicit_auc"] > 0.96


def test_draws_of_a_row_that_stands_for_several():
    key = np.arange(100_000)
    for n in (3.0, 60.0, 5000.0):
        a = forest.draws(key, 0, 7, n)
        assert abs(a.mean() / n - 1) < 0.01 and abs(a.var() / n - 1) < 0.03
    mixed = forest.draws(key, 0, 7, np.where(key < 40_000, 1.0, 60.0))
    assert np.array_equal(mixed, np.concatenate((forest.draws(key[:40_000], 0, 7, 1.0), forest.draws(key[40_000:], 0, 7, 60.0))))


def test_a_tree_grown_in_blocks():
    """Large nodes alone, then blocks of subtrees: with one feature the same cuts as at once."""
    rng = np.random.default_rng(5)
    codes, y, count = rng.integers(0, 256, (3000, 1)).astype(np.uint8), rng.integers(0, 2, 3000), rng.poisson(1, 3000)
    for depth in (None, 4):
        one, blocks = (forest.grow(codes, y, count, (0.7, 1.9), 1, depth, rng, block) for block in (1 << 16, 50))
        assert nested(one) == nested(blocks)


@pytest.mark.parametrize("n_features", [4, 300])
def test_a_packed_tree_scores_as_the_tree(n_features):
    rng = np.random.default_rng(6)
    codes, y = rng.integers(0, 9, (700, n_features)).astype(np.uint8), rng.integers(0, 2, 700)
    tree = forest.grow(codes, y, np.ones(700, int), (0.4, 1.0), 2, 6, rng)
    held = forest.packed(tree, n_features)
    sent = type("Sent", (), {"value": [tuple(held.values())] * 2})
    batch = pa.RecordBatch.from_pydict({"codes": [r.tobytes() for r in codes], "votes": [0.5] * 700})
    (found,) = forest._votes([batch.slice(0, 300), batch.slice(300)], n_features, sent, at_once=64)
    for row, votes in zip(codes, found["votes"].to_pylist(), strict=True):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["child"][at] + (row[tree["feature"][at]] > tree["cut"][at])
        assert votes == pytest.approx(0.5 + 2 * tree["p"][at])


def test_a_group_s_trees_from_what_is_dealt_to_it():
    """Numbers of copies travel in a byte or in eight; trees are those of the rows' draws, in whatever order the rows come."""
    rng = np.random.default_rng(8)
    codes, y, n = rng.integers(0, 50, (600, 2)).astype(np.uint8), rng.integers(0, 2, 600).astype(np.uint8), rng.integers(1, 200, 600)
    n[400:] += 200
    halves = [forest._sent(codes[s], y[s], n[s]) for s in (slice(400, None), slice(0, 400))]
    assert [len(x[2]) for x in halves] == [8 * 200, 400]
    batch = pa.RecordBatch.from_pydict({"grp": [1, 1], **{c: [x[i] for x in halves] for i, c in enumerate(("codes", "y", "n"))}})
    found = [r for made in forest._grown([batch], 2, 5, 3, 0, (1.0, 1.0), 1, None) for r in made.to_pylist()]
    assert [r["tree"] for r in found] == [3, 4]
    for r in found:
        count = forest.draws(forest.keys(codes, y), r["tree"], 0, n)
        tree = forest.grow(codes, y, count, (1.0, 1.0), 1, None, np.random.default_rng([0, r["tree"]]))
        assert {k: r[k] for k in ("feature", "cut", "p")} == forest.packed(tree, 2)


def test_rows_are_not_dealt_to_each_tree(spark):
    """What a fit shuffles doesn't grow with the number of trees, also where trees are grown on a part of the rows."""
    train = curved(spark, 3000).filter("split = 'train'").select(F.xxhash64("tx_id").alias("key"), "features", "y")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    moved = []
    for trees in (25, 200):
        before = written()
        assert forest.fit(train, (1.0, 1.0), num_trees=trees, tree_rows=400)["trees"].count() == trees
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        moved.append(written() - before)
    assert 0 < moved[1] < 2 * moved[0]


def test_equal_rows_are_held_once(spark, monkeypatch):
    """Copies of rows count in a tree's draws and are all scored, but their bins are written, dealt and scored once."""
    kept, parts = {}, curved(spark, 900)
    copies = parts.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("tx_id", F.concat("tx_id", F.lit("-"), "copy")).drop("copy")
    monkeypatch.setattr(forest, "stored", lambda df, label: kept.setdefault(label, []).append(out := stored(df, label)) or out)
    monkeypatch.setattr(forest, "dropped", lambda df: None)
    scored = models.fit_predict(copies, "rf", num_trees=16)
    assert scored.count() == 40 * 300 and floor.evaluate(scored)["illicit_auc"] > 0.97
    assert scored.groupBy(F.substring_index("tx_id", "-", 1)).agg(F.countDistinct("score").alias("n"), F.count("*").alias("rows")).filter("n = 1 AND rows = 40").count() == 300
    (rows,) = kept["forest-rows"]
    assert rows.count() <= 600 and rows.agg(F.sum("n")).first()[0] == 40 * 600
    assert all(x.count() <= 300 for x in kept["forest-votes"])


def test_logistic_fit_is_the_optimum(spark):
    parts = curved(spark, 600).select("tx_id", F.transform("features", lambda v: F.coalesce(v, F.lit(0.5))).alias("features"), "y", "split")
    rows = models.logistic_gradient(parts).collect()
    assert len(rows) == 4 and all(abs(r.gradient) < 1e-7 for r in rows)
    early = models.logistic_gradient(parts, max_iter=1).collect()
    assert max(abs(r.gradient) for r in early) > 1e-4


def test_grid_fits_a_seedless_baseline_once(spark, separable, tmp_path, monkeypatch):
    fits, fit = [], floor.fit_predict
    monkeypatch.setattr(floor, "fit_predict", lambda parts, baseline, seed, **how: fits.append((baseline, seed)) or fit(parts, baseline, seed, **how))
    path = str(tmp_path / "log")
    floor.run_floor_grid(separable, SPLIT, path, num_trees=8)
    assert fits == [("rf", 0), ("rf", 1), ("rf", 2), ("lr", 0)]
    log = runlog.read_runs(spark, path).collect()
    assert len(log) == 6 and len({r.config_hash for r in log}) == 6 and len({r.run_id for r in log}) == 6
    assert {json.loads(r.metrics_json)["illicit_f1"] for r in log} == {1.0}


def test_grid_writes_its_rows_once(spark, separable, tmp_path, monkeypatch):
    """Each fit reads the one table of the split, and a forest's trees go once its votes are written."""
    kept, left = [], []
    monkeypatch.setattr(models, "stored", lambda df, label: kept.append(label) or stored(df, label))
    monkeypatch.setattr(forest, "stored", lambda df, label: left.append((label, out := stored(df, label))) or out)
    floor.run_floor_grid(separable, SPLIT, str(tmp_path / "log"), num_trees=8)
    assert kept == []
    trees = [urlparse(path).path for label, df in left if label == "forest" for path in df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().mkString(",").split(",")]
    assert len(trees) == 3 and not any(Path(x).exists() for x in trees)


def test_part_files_tell_a_rewritten_log(spark, tmp_path):
    path = str(tmp_path / "log")
    row = lambda k: spark.createDataFrame([(f"t{k}", f"r{k}", "m", None, "h", None, False, k, "d", "{}", 1.0, "n")], runlog.RUN_LOG).coalesce(1)
    runlog.append_runs(row(0), path)
    known = stored(runlog.part_digests(spark, path), "parts")
    runlog.append_runs(row(1), path)
    runlog.assert_parts_kept(spark, path, known)
    every = stored(runlog.part_digests(spark, path, known), "parts")
    assert (known.count(), every.count(), every.join(known, ["file", "digest"]).count()) == (1, 2, 1)
    first = tmp_path / "log" / known.first().file.rsplit("/", 1)[1]
    held = first.read_bytes()
    (first.parent / f".{first.name}.crc").unlink()  # or the local file system itself would refuse what is written below
    first.touch()
    runlog.assert_parts_kept(spark, path, every)  # another time, the same content
    first.write_bytes(held[:-1] + bytes([held[-1] ^ 1]))
    with pytest.raises(AssertionError, match="is rewritten"):
        runlog.assert_parts_kept(spark, path, every)
    first.write_bytes(held + b"x")
    assert [r.fault for r in runlog.broken_parts(spark, path, every).collect()] == ["rewritten"]
    first.unlink()
    assert [r.fault for r in runlog.broken_parts(spark, path, every).collect()] == ["lost"]


def test_auc_by_range_parts(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(0, 2)), float(rng.integers(0, 300)) / 300) for k in ("a", "a", "a", "b") for _ in range(400)]
    scored = spark.createDataFrame(rows, "k string, y int, score double").repartition(5)
    one = {r.k: round(r.illicit_auc, 12) for r in metrics.roc_auc_by(scored, "k").collect()}
    assert one == {r.k: round(r.illicit_auc, 12) for r in metrics.roc_auc_by(scored, "k", window_scores=10).collect()}
    assert one == {k: round(metrics.roc_auc(scored.filter(f"k = '{k}'")), 12) for k in "ab"}
