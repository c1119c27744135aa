"""The registered queries of the graph library, each with its SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import checks, edges, inductive, metrics, models, nodes, split
from ..sources import graph, runlog
from ..sources.store import bucketed, shared_dir, stored
from . import bindings as b
from . import floor, report

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Common table expressions of the SQL.
ORDERS = """o AS (SELECT o_orderkey AS tx_id, o_custkey, o_orderdate, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS time_step,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS y FROM orders)"""
EDGES = "e AS (SELECT * FROM (SELECT tx_id AS src, lead(tx_id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, tx_id) AS dst FROM o) WHERE dst IS NOT NULL)"
FEATURES = """f AS (SELECT tx_id, time_step, y, CAST(o_totalprice AS DOUBLE) AS f0, CAST(coalesce(n, 0) AS DOUBLE) AS f1, CAST(coalesce(q, 0) AS DOUBLE) AS f2, CAST(coalesce(p, 0) AS DOUBLE) AS f3, CAST(coalesce(d, 0) AS DOUBLE) AS f4
  FROM o JOIN orders ON o.tx_id = orders.o_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, sum(l_extendedprice) AS p, avg(l_discount) AS d FROM lineitem GROUP BY l_orderkey) ON l_orderkey = tx_id)"""
SCORED = """s AS (SELECT baseline, seed, tx_id, y, ((tx_id * mult + seed * 31) % 1009) / 1009.0 AS score, CAST(((tx_id * mult + seed * 31) % 1009) / 1009.0 > 0.5 AS INT) AS pred
  FROM o, (VALUES ('mod_a', 7919), ('mod_b', 104729)) AS m(baseline, mult), (VALUES (0), (1), (2)) AS k(seed) WHERE time_step BETWEEN 56 AND 80 AND y <> -1)"""
COUNTS = "c AS (SELECT baseline, seed, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn FROM s GROUP BY ALL)"
METRICS = """m AS (SELECT baseline, seed, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision FROM c)"""
AUC = """g AS (SELECT baseline, seed, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM s GROUP BY ALL),
a AS (SELECT baseline, seed, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) END AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY baseline, seed ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) GROUP BY ALL)"""
SUPPORT = "k AS (SELECT count(*) FILTER (time_step <= 55) AS n_train, count(*) FILTER (time_step BETWEEN 56 AND 80) AS n_test, count(*) FILTER (time_step BETWEEN 56 AND 80 AND y = 1) AS n_test_illicit FROM o WHERE y <> -1)"
RUNS = f"{ORDERS}, {SCORED}, {COUNTS}, {METRICS}, {AUC}"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- nodes ------------------------------------------------------------------------------------------------------


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.attach_labels(b.order_nodes(spark, sf_dir), b.order_classes(spark, sf_dir), order_col="class")


@query(f"WITH {ORDERS} SELECT tx_id, time_step, y, y <> -1 AS labelled FROM o")
def node_labels(spark, sf_dir):
    return labelled_orders(spark, sf_dir)


@query(f"WITH {ORDERS}, {FEATURES} SELECT tx_id, time_step, y, y <> -1 AS labelled, round(f0, 2) AS f0, round(f3, 2) AS f3 FROM f")
def node_labels_bucketed(spark, sf_dir):
    """Labels joined to nodes with features that lie in a table bucketed by id: the features aren't moved."""
    held = bucketed(b.order_features(spark, sf_dir).select("tx_id", "time_step", "features"), "tx_id", "orders")
    found = nodes.attach_labels(held, b.order_classes(spark, sf_dir), order_col="class")
    return found.select("tx_id", "time_step", "y", "labelled", *[F.round(F.col("features")[i], 2).alias(f"f{i}") for i in (0, 3)])


@query(f"WITH {ORDERS} SELECT y, count(*) AS n FROM o GROUP BY y")
def label_profile(spark, sf_dir):
    return nodes.label_profile(labelled_orders(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT time_step, y, count(*) AS n FROM o GROUP BY time_step, y")
def label_profile_by_step(spark, sf_dir):
    return nodes.label_profile(labelled_orders(spark, sf_dir), "time_step")


@query(f"WITH {ORDERS} SELECT count(*) AS n_nodes, count(DISTINCT time_step) AS n_steps, max(time_step) AS max_step, 5 AS min_features, 5 AS max_features FROM o")
def dataset_profile(spark, sf_dir):
    return checks.dataset_profile(b.order_features(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT tx_id, row_number() OVER (ORDER BY tx_id) - 1 AS node_idx FROM o")
def node_index(spark, sf_dir):
    return nodes.assign_node_index(b.order_nodes(spark, sf_dir))


@query("SELECT vec_id AS tx_id, embedding[1:16] AS features FROM embeddings")
def local_features(spark, sf_dir):
    vectors = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tx_id"), F.col("embedding").alias("features"))
    return split.local_features(vectors, 16)


@query("SELECT p_partkey AS tx_id, CAST(p_size AS INT) AS time_step, [CAST(p_retailprice AS FLOAT)] AS features FROM part")
def folded_features(spark, sf_dir):
    return graph.fold_features(b.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"))


# ---- edges ------------------------------------------------------------------------------------------------------


@query(f"WITH {ORDERS}, {EDGES}, i AS (SELECT tx_id, row_number() OVER (ORDER BY tx_id) - 1 AS node_idx FROM o) SELECT a.node_idx AS src_idx, z.node_idx AS dst_idx FROM e JOIN i a ON a.tx_id = src JOIN i z ON z.tx_id = dst")
def edges_remapped(spark, sf_dir):
    return edges.remap_edges(b.order_edges(spark, sf_dir), nodes.assign_node_index(b.order_nodes(spark, sf_dir)))


@query("SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) OR l_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def edges_dangling(spark, sf_dir):
    return edges.dangling_edges(b.part_edges(spark, sf_dir), b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tx_id")))


@query("SELECT DISTINCT l_partkey AS tx_id FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION SELECT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def endpoints_dangling(spark, sf_dir):
    return edges.dangling_endpoints(b.part_edges(spark, sf_dir), b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tx_id")))


@query("SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem")
def edges_symmetrised(spark, sf_dir):
    return edges.symmetrise_edges(b.part_edges(spark, sf_dir))


@query("SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def edges_directed(spark, sf_dir):
    return b.part_edges(spark, sf_dir)


# ---- split and training subgraph --------------------------------------------------------------------------------


@query(f"WITH {ORDERS} SELECT tx_id, time_step, time_step <= 55 AS train_mask, time_step BETWEEN 56 AND 80 AS test_mask FROM o")
def split_masks(spark, sf_dir):
    return split.split_masks(b.order_nodes(spark, sf_dir), b.MONTHS)


@query(f"WITH {ORDERS} SELECT tx_id, time_step, time_step <= 40 AS train_mask, time_step >= 50 AS test_mask FROM o")
def split_masks_open(spark, sf_dir):
    return split.split_masks(b.order_nodes(spark, sf_dir), split.TemporalSplit(40, 50))


@query("SELECT event_id AS tx_id, ts, ts <= TIMESTAMP '2024-01-20 00:00:00' AS train_mask, ts >= TIMESTAMP '2024-01-21 00:00:00' AND ts <= TIMESTAMP '2024-01-28 12:00:00' AS test_mask FROM events")
def split_masks_timestamp(spark, sf_dir):
    days = split.TemporalSplit(datetime(2024, 1, 20), datetime(2024, 1, 21), datetime(2024, 1, 28, 12), "ts")
    return split.split_masks(b.table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), "ts"), days)


@query(f"WITH {ORDERS}, {EDGES} SELECT src, dst, a.time_step AS src_time, z.time_step AS dst_time FROM e LEFT JOIN o a ON a.tx_id = src LEFT JOIN o z ON z.tx_id = dst")
def edge_endpoint_times(spark, sf_dir):
    return inductive.edge_endpoint_times(b.order_edges(spark, sf_dir), b.order_nodes(spark, sf_dir))


@query(f"WITH {ORDERS}, {EDGES} SELECT src, dst FROM e JOIN o a ON a.tx_id = src JOIN o z ON z.tx_id = dst WHERE a.time_step <= 55 AND z.time_step <= 55")
def induced_train_subgraph(spark, sf_dir):
    return inductive.induced_train_subgraph(b.order_edges(spark, sf_dir), b.order_nodes(spark, sf_dir), b.MONTHS)


@query(
    f"WITH {ORDERS}, {EDGES} SELECT count(*) AS n_edges, count(*) FILTER (a.time_step > 55 OR z.time_step > 55) AS n_leaking, count(*) FILTER (a.time_step <= 55 AND z.time_step <= 55) AS n_induced "
    "FROM e JOIN o a ON a.tx_id = src JOIN o z ON z.tx_id = dst"
)
def induced_with_leakage(spark, sf_dir):
    """The induced edges written, and the raw edges' leakage, counted by the same job."""
    inside, seen = inductive.induced_and_leakage(b.order_edges(spark, sf_dir), b.order_nodes(spark, sf_dir), b.MONTHS)
    n = stored(inside, "induced").count()
    return spark.createDataFrame([(seen.get["n_edges"], seen.get["n_leaking"], n)], "n_edges long, n_leaking long, n_induced long")


@query("SELECT l_suppkey AS src, l_partkey AS dst, a.p_size AS src_time, z.p_size AS dst_time FROM lineitem LEFT JOIN part a ON a.p_partkey = l_suppkey LEFT JOIN part z ON z.p_partkey = l_partkey")
def hub_endpoint_times(spark, sf_dir):
    """End times of a graph in which a few ids hold all edges' sources: their rows are dealt to parts."""
    times = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tx_id"), F.col("p_size").alias("time_step"))
    return inductive.edge_endpoint_times(b.part_edges(spark, sf_dir), times, hub_rows=200)


@query(f"WITH {ORDERS} SELECT tx_id, time_step, time_step <= 55 AS train_mask FROM o")
def induced_train_nodes(spark, sf_dir):
    return inductive.train_nodes(b.order_nodes(spark, sf_dir), b.MONTHS)


@query(f"WITH {ORDERS}, {EDGES} SELECT count(*) AS n_edges, count(*) FILTER (a.time_step > 55 OR z.time_step > 55) AS n_leaking FROM e JOIN o a ON a.tx_id = src JOIN o z ON z.tx_id = dst")
def leakage_report_raw(spark, sf_dir):
    return inductive.leakage_report(b.order_edges(spark, sf_dir), b.order_nodes(spark, sf_dir), b.MONTHS)


@query(f"WITH {ORDERS}, {EDGES} SELECT count(*) AS n_edges, 0 AS n_leaking FROM e JOIN o a ON a.tx_id = src JOIN o z ON z.tx_id = dst WHERE a.time_step <= 55 AND z.time_step <= 55")
def leakage_report_induced(spark, sf_dir):
    n = b.order_nodes(spark, sf_dir)
    return inductive.leakage_report(inductive.induced_train_subgraph(b.order_edges(spark, sf_dir), n, b.MONTHS), n, b.MONTHS)


@query(f"WITH {ORDERS} SELECT tx_id, time_step, y, y <> -1 AS labelled, CASE WHEN time_step <= 55 THEN 'train' ELSE 'test' END AS split FROM o WHERE y <> -1 AND time_step <= 80")
def labelled_split(spark, sf_dir):
    return split.labelled_split(labelled_orders(spark, sf_dir), b.MONTHS)


@query(f"WITH {ORDERS} SELECT count(*) FILTER (time_step <= 55) AS n_train, count(*) FILTER (time_step BETWEEN 56 AND 80) AS n_test, count(*) FILTER (time_step BETWEEN 56 AND 80 AND y = 1) AS n_test_illicit FROM o WHERE y <> -1")
def support_counts(spark, sf_dir):
    return split.support_counts(split.labelled_split(labelled_orders(spark, sf_dir), b.MONTHS))


# ---- models and metrics -----------------------------------------------------------------------------------------


@query(f"WITH {ORDERS}, t AS (SELECT y, count(*) AS n FROM o WHERE y <> -1 AND time_step <= 55 GROUP BY y) SELECT y, n, round((SELECT sum(n) FROM t) / ((SELECT count(*) FROM t) * n), 6) AS weight FROM t")
def class_weights(spark, sf_dir):
    train = split.labelled_split(labelled_orders(spark, sf_dir), b.MONTHS).filter("split = 'train'")
    return rounded(models.class_weights(train), "weight")


STATS = ", ".join(f"avg(f{i}) AS m{i}, CASE WHEN stddev_pop(f{i}) > 0 THEN stddev_pop(f{i}) ELSE 1 END AS s{i}" for i in range(5))


@query(f"WITH {ORDERS}, {FEATURES}, t AS (SELECT {STATS} FROM f WHERE y <> -1 AND time_step <= 55) " + " UNION ALL ".join(f"SELECT {i} AS feature, round(m{i}, 6) AS mean, round(s{i}, 6) AS scale FROM t" for i in range(5)))
def scaler_stats(spark, sf_dir):
    train = split.labelled_split(b.order_features(spark, sf_dir), b.MONTHS).filter("split = 'train'")
    stats = models.scaler_stats(train)
    each = stats.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("feature", "v")).select("feature", F.col("v.mean").alias("mean"), F.col("v.scale").alias("scale"))
    return rounded(each, "mean", "scale")


@query(f"WITH {ORDERS}, {FEATURES}, t AS (SELECT {STATS} FROM f WHERE y <> -1 AND time_step <= 55) SELECT tx_id, {', '.join(f'round((f{i} - m{i}) / s{i}, 5) AS f{i}' for i in range(5))} FROM f, t WHERE y <> -1 AND time_step <= 80")
def standardised_features(spark, sf_dir):
    parts = split.labelled_split(b.order_features(spark, sf_dir), b.MONTHS)
    scaled = models.standardise(parts, models.scaler_stats(parts.filter("split = 'train'")))
    return scaled.select("tx_id", *[F.round(F.col("features")[i], 5).alias(f"f{i}") for i in range(5)])


@query(f"WITH {ORDERS}, {SCORED}, {COUNTS}, {METRICS} SELECT baseline, seed, round(f1, 6) AS illicit_f1, round(recall, 6) AS illicit_recall, round(precision, 6) AS illicit_precision FROM m")
def floor_metrics(spark, sf_dir):
    return rounded(metrics.floor_metrics(b.scored_orders(spark, sf_dir), "baseline", "seed"), "illicit_f1", "illicit_recall", "illicit_precision")


@query(f"WITH {ORDERS}, {SCORED}, {AUC} SELECT round(auc, 6) AS illicit_auc FROM a WHERE baseline = 'mod_a' AND seed = 0")
def roc_auc(spark, sf_dir):
    one = b.scored_orders(spark, sf_dir).filter("baseline = 'mod_a' AND seed = 0")
    return rounded(spark.createDataFrame([(metrics.roc_auc(one),)], "illicit_auc double"), "illicit_auc")


@query(f"WITH {ORDERS}, {SCORED}, {AUC} SELECT baseline, seed, round(auc, 6) AS illicit_auc FROM a")
def roc_auc_by_run(spark, sf_dir):
    return rounded(metrics.roc_auc_by(b.scored_orders(spark, sf_dir), "baseline", "seed"), "illicit_auc")


def _fitted(spark, sf_dir, baseline):
    parts = split.labelled_split(b.order_features(spark, sf_dir), b.MONTHS)
    return models.fit_predict(parts, baseline)


@query()
def rf_floor(spark, sf_dir):
    """The forest's score of every labelled test order, 300 trees of any depth."""
    return _fitted(spark, sf_dir, "rf")


@query(f"WITH {ORDERS} SELECT tx_id, y, true AS scored, true AS pred_follows FROM o WHERE y <> -1 AND time_step BETWEEN 56 AND 80")
def rf_floor_protocol(spark, sf_dir):
    """What a plain rule can say of ``rf_floor``: its rows, their labels, scores that are probabilities, predictions that follow them."""
    found = _fitted(spark, sf_dir, "rf")
    return found.select("tx_id", "y", F.col("score").between(0, 1).alias("scored"), (F.col("pred") == (F.col("score") > 0.5).cast("int")).alias("pred_follows"))


@query(
    f"WITH {ORDERS}, {FEATURES} SELECT count(*) FILTER (time_step <= 55) AS n_train, count(*) FILTER (time_step >= 56) AS n_test, count(*) FILTER (time_step >= 56 AND f1 >= 4) AS n_test_illicit, "
    "CAST(1 AS DOUBLE) AS illicit_f1, CAST(1 AS DOUBLE) AS illicit_recall, CAST(1 AS DOUBLE) AS illicit_precision, CAST(1 AS DOUBLE) AS illicit_auc FROM f WHERE time_step <= 80"
)
def rf_separable(spark, sf_dir):
    """The forest where each feature tells the label: an order's lines, four or more being positive. Every test order is right."""
    lines = F.col("features")[1]
    told = b.order_features(spark, sf_dir).select("tx_id", "time_step", F.array(lines, lines * 2 + 1, -lines).alias("features"), (lines >= 4).cast("int").alias("y"), F.lit(True).alias("labelled"))
    parts = stored(split.labelled_split(told, b.MONTHS), "separable")
    scored = stored(models.fit_predict(parts, "rf"), "separable-scored")
    auc = F.lit(metrics.roc_auc(scored)).cast("double").alias("illicit_auc")
    return split.support_counts(parts).join(F.broadcast(metrics.floor_metrics(scored))).select("n_train", "n_test", "n_test_illicit", "illicit_f1", "illicit_recall", "illicit_precision", auc)  # one row each


@query()
def lr_floor(spark, sf_dir):
    return _fitted(spark, sf_dir, "lr")


@query(f"WITH {ORDERS}, {SUPPORT} SELECT CAST(unnest(range(6)) AS INT) AS coefficient, n_train, CAST(0 AS DOUBLE) AS gradient FROM k")
def lr_gradient(spark, sf_dir):
    """The gradient of the penalised logistic loss at the coefficients of ``lr_floor``, to six digits: 0 only at its one optimum."""
    parts = stored(split.labelled_split(b.order_features(spark, sf_dir), b.MONTHS), "gradient-parts")
    found = models.logistic_gradient(parts).select("coefficient", (F.round("gradient", 6) + 0.0).alias("gradient"))
    return found.join(F.broadcast(split.support_counts(parts).select("n_train")))  # one row


# ---- run log and report -----------------------------------------------------------------------------------------


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of the stand-in scorers' runs over the labelled orders."""
    scored = stored(b.scored_orders(spark, sf_dir), "scored")
    found = metrics.floor_metrics(scored, "baseline", "seed").join(metrics.roc_auc_by(scored, "baseline", "seed"), ["baseline", "seed"])
    support = split.support_counts(split.labelled_split(labelled_orders(spark, sf_dir), b.MONTHS))
    cell = lambda c: F.round(c, 6)
    result = scalar.metrics_to_json(
        baseline=F.col("baseline"), illicit_auc=cell("illicit_auc"), illicit_f1=cell("illicit_f1"), illicit_precision=cell("illicit_precision"), illicit_recall=cell("illicit_recall"),
        n_test=F.col("n_test"), n_test_illicit=F.col("n_test_illicit"), n_train=F.col("n_train"), test_window=F.lit(b.MONTHS.test_window),
    )
    config = F.struct(F.col("baseline"), F.lit("orders").alias("model"), F.col("seed"), F.struct(F.lit(80).alias("test_max"), F.lit(56).alias("test_min"), F.lit(55).alias("train_max")).alias("split"))
    rows = found.join(F.broadcast(support)).select(  # one row
        F.lit("2024-02-01T00:00:00+00:00").alias("timestamp_utc"), F.concat(F.lit("orders-"), "baseline", F.lit("-"), F.col("seed").cast("string")).alias("run_id"), F.lit("orders").alias("model"),
        scalar.config_hash_struct(config).alias("config_hash"), F.lit(False).alias("git_dirty"), "seed", F.lit("tables").alias("data_snapshot_id"), result.alias("metrics_json"), F.lit(0.5).alias("wall_clock_s"),
        F.concat(F.lit('scorer "'), "baseline", F.lit('", stand-in')).alias("notes"),
    )
    return runlog.conform(rows)


RUN_HASH = """sha256('{"baseline":"' || baseline || '","model":"orders","seed":' || seed || ',"split":{"test_max":80,"test_min":56,"train_max":55}}')"""
LOG = f"""WITH {RUNS}, log AS (SELECT 'orders-' || baseline || '-' || seed AS run_id, {RUN_HASH} AS config_hash, seed, 'tables' AS data_snapshot_id, 'scorer "' || baseline || '", stand-in' AS notes,
  baseline, round(f1, 6) AS illicit_f1, round(recall, 6) AS illicit_recall, round(precision, 6) AS illicit_precision, round(auc, 6) AS illicit_auc FROM m JOIN a USING (baseline, seed))"""


def _log(spark, sf_dir, format="parquet", times=1):
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    rows = run_rows(spark, sf_dir)
    for _ in range(times):
        runlog.append_runs(rows, path, format)
    return path


@query(
    f"{LOG}, {SUPPORT} SELECT '2024-02-01T00:00:00+00:00' AS timestamp_utc, run_id, 'orders' AS model, CAST(NULL AS VARCHAR) AS phase, config_hash, CAST(NULL AS VARCHAR) AS git_commit, false AS git_dirty, seed, data_snapshot_id, "
    "baseline, illicit_auc, illicit_f1, illicit_precision, illicit_recall, n_test, n_test_illicit, n_train, '56-80' AS test_window, 0.5::DOUBLE AS wall_clock_s, notes FROM log, k"
)
def run_log_roundtrip(spark, sf_dir):
    """All columns of a log written as CSV and read back; the JSON cell as its fields."""
    log = runlog.read_runs(spark, _log(spark, sf_dir, "csv"), format="csv")
    cells = [f"m.{c}" if c == "metrics_json" else c for c in log.columns]
    return log.withColumn("m", scalar.parse_metrics(F.col("metrics_json"))).select(*["m.*" if c == "m.metrics_json" else c for c in cells])


@query(f"{LOG} SELECT run_id, seed FROM log WHERE seed = 1")
def run_log_lost(spark, sf_dir):
    """Rows that a log which was rewritten no longer has: those of seed 1 are gone, and another row came in."""
    before = stored(run_rows(spark, sf_dir), "runs-before")
    after = before.filter("seed <> 1").unionByName(before.filter("seed = 0").withColumn("notes", F.lit("again")))
    return runlog.lost_rows(before, after).select("run_id", "seed")


@query(f"{LOG} SELECT baseline || '-' || seed AS notes FROM log WHERE seed <> 2")
def run_log_invalid(spark, sf_dir):
    """Rows with an empty or missing required cell."""
    rows = run_rows(spark, sf_dir)
    named = rows.withColumn("notes", F.regexp_replace("run_id", "^orders-", ""))
    broken = named.withColumn("run_id", F.when(F.col("seed") == 0, F.lit("")).otherwise(F.col("run_id")))
    broken = broken.withColumn("metrics_json", F.when(F.col("seed") == 1, F.lit(None)).otherwise(F.col("metrics_json")))
    return runlog.invalid_rows(broken).select("notes")


@query(f"{LOG} SELECT config_hash, 2 AS runs, CASE WHEN baseline = 'mod_a' THEN 2 ELSE 1 END AS n_metrics, baseline <> 'mod_a' AS reproducible FROM log")
def repro_conflict(spark, sf_dir):
    """Every configuration run twice; one scorer's second runs have another result."""
    rows = stored(run_rows(spark, sf_dir), "runs-first")
    other = F.when(F.col("run_id").contains("mod_a"), F.lit("{}")).otherwise(F.col("metrics_json"))
    return runlog.reproducibility_check(rows.unionByName(rows.withColumn("metrics_json", other)))


@query(
    """SELECT o_orderkey, 'orders-' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%dT%H%M%SZ') || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS run_id,
  CAST(o_orderkey AS VARCHAR) AS key_cell, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS flag_cell, CASE WHEN o_orderstatus = 'P' THEN o_orderstatus ELSE '' END AS null_cell,
  CAST(o_orderkey AS VARCHAR) || '-' || CASE WHEN o_orderstatus = 'P' THEN 'end' ELSE CAST(o_custkey AS VARCHAR) END AS test_window FROM orders"""
)
def run_cells(spark, sf_dir):
    """Run ids, log cells and test windows as columns."""
    o = b.table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        "o_orderkey", scalar.run_id(F.lit("orders"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")).alias("run_id"), scalar.serialise(F.col("o_orderkey")).alias("key_cell"),
        scalar.serialise(status == "F").alias("flag_cell"), scalar.serialise(F.when(status == "P", status)).alias("null_cell"), scalar.test_window(F.col("o_orderkey"), F.when(status != "P", F.col("o_custkey"))).alias("test_window"),
    )


@query(
    f"WITH {ORDERS}, {SUPPORT}, b AS (SELECT unnest(['rf', 'rf', 'rf', 'lr', 'lr', 'lr', 'unknown']) AS baseline, unnest([0, 1, 2, 0, 1, 2, 0]) AS seed, unnest([false, false, false, false, false, false, true]) AS errored) "
    "SELECT baseline, seed, errored, CASE WHEN NOT errored THEN CAST(n_train AS VARCHAR) END AS n_train, CASE WHEN NOT errored THEN CAST(n_test AS VARCHAR) END AS n_test, CASE WHEN NOT errored THEN CAST(n_test_illicit AS VARCHAR) END AS n_test_illicit, CASE WHEN NOT errored THEN '56-80' END AS test_window, NOT errored AS scored FROM b, k"
)
def floor_grid(spark, sf_dir):
    """Both baselines with three seeds fitted, scored, evaluated and logged in one append; then a run of an unknown baseline, which leaves an errored row."""
    path = f"{shared_dir(spark)}/grid-{uuid.uuid4().hex}"
    n = stored(b.order_features(spark, sf_dir), "grid-nodes")
    floor.run_floor_grid(n, b.MONTHS, path)
    try:
        floor.run_floor(split.labelled_split(n, b.MONTHS), b.MONTHS, "unknown", 0, path)
    except ValueError:
        pass
    log = runlog.read_runs(spark, path).withColumn("m", scalar.parse_metrics(F.col("metrics_json")))
    scored = F.col("m.illicit_f1").between(0, 1) & F.col("m.illicit_auc").between(0, 1)
    return log.select(
        F.regexp_extract("notes", r"floor: (\w+)", 1).alias("baseline"), "seed", F.col("notes").endswith(" ERRORED").alias("errored"), *[F.col(f"m.{c}").cast("string").alias(c) for c in ("n_train", "n_test", "n_test_illicit")], "m.test_window", F.coalesce(scored, F.lit(False)).alias("scored"),
    )


@query(
    f"{LOG}, {SUPPORT} SELECT n_train, n_test, n_test_illicit, (SELECT string_agg(run_id, ', ' ORDER BY run_id) FROM log) AS run_ids, 'tables' AS snapshot, CAST((SELECT count(*) FROM log) + (SELECT count(DISTINCT baseline) FROM log) AS BIGINT) AS rows FROM k"
)
def gate_report(spark, sf_dir):
    """The written report, read back: its support line, run ids, snapshot and the rows of its table."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    text = report.write_gate_report(stored(run_rows(spark, sf_dir), "runs-report"), path)
    lines = spark.createDataFrame([(text,)], "text string")
    number = lambda pattern: F.regexp_extract("text", pattern, 1).cast("long")
    rows = spark.read.option("header", True).csv(path).agg(F.count("*").alias("rows"))
    return lines.select(
        number(r"train (\d+),").alias("n_train"), number(r"test (\d+) \(").alias("n_test"), number(r"\((\d+) positive").alias("n_test_illicit"), F.regexp_extract("text", r"runs: ([^\n]*)", 1).alias("run_ids"), F.regexp_extract("text", r"data (\w+)", 1).alias("snapshot"),
    ).join(F.broadcast(rows))  # fmt: skip  # one row each


@query(f"{LOG} SELECT run_id, config_hash, seed FROM log WHERE baseline = 'mod_b'")
def run_log_batch(spark, sf_dir):
    batch = run_rows(spark, sf_dir).filter("run_id LIKE 'orders-mod_b-%'").select("run_id")
    return runlog.read_runs(spark, _log(spark, sf_dir), batch).select("run_id", "config_hash", "seed")


@query(f"{LOG}, k AS (SELECT count(*) FILTER (time_step <= 55) AS n_train, count(*) FILTER (time_step BETWEEN 56 AND 80) AS n_test, count(*) FILTER (time_step BETWEEN 56 AND 80 AND y = 1) AS n_test_illicit FROM o WHERE y <> -1) SELECT run_id, seed, baseline, illicit_auc, illicit_f1, illicit_precision, illicit_recall, n_test, n_test_illicit, n_train, '56-80' AS test_window FROM log, k")
def metrics_parsed(spark, sf_dir):
    return report.parsed(run_rows(spark, sf_dir))


@query(f"{LOG} SELECT baseline, count(*) AS runs, round(avg(illicit_f1), 6) AS f1_mean, round(stddev_pop(illicit_f1), 6) AS f1_std, round(avg(illicit_recall), 6) AS recall_mean, round(stddev_pop(illicit_recall), 6) AS recall_std, round(avg(illicit_auc), 6) AS auc_mean, round(stddev_pop(illicit_auc), 6) AS auc_std FROM log GROUP BY baseline")
def seed_summary(spark, sf_dir):
    return rounded(report.seed_summary(run_rows(spark, sf_dir)), *[f"{k}_{s}" for k in report.SHOWN for s in ("mean", "std")])


@query(f"""{LOG} SELECT baseline, seed::BIGINT AS position, seed::VARCHAR AS "row", format('{{:.4f}}', illicit_f1) AS f1, format('{{:.4f}}', illicit_recall) AS recall, format('{{:.4f}}', illicit_auc) AS auc FROM log
UNION ALL SELECT baseline, 2147483648, 'mean ± std', format('{{:.4f}} ± {{:.4f}}', avg(illicit_f1), stddev_pop(illicit_f1)), format('{{:.4f}} ± {{:.4f}}', avg(illicit_recall), stddev_pop(illicit_recall)), format('{{:.4f}} ± {{:.4f}}', avg(illicit_auc), stddev_pop(illicit_auc)) FROM log GROUP BY baseline""")
def gate_table(spark, sf_dir):
    return report.gate_table(run_rows(spark, sf_dir))


@query(f"{LOG} SELECT config_hash, 2 AS runs, 1 AS n_metrics, true AS reproducible FROM log")
def repro_check(spark, sf_dir):
    return runlog.reproducibility_check(runlog.read_runs(spark, _log(spark, sf_dir, times=2)))


@query(f"{LOG} SELECT count(*) AS n_before, 2 * count(*) AS n_after, 0 AS n_lost, 0 AS n_invalid FROM log")
def append_only_check(spark, sf_dir):
    before = run_rows(spark, sf_dir)
    after = runlog.read_runs(spark, _log(spark, sf_dir, times=2))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(before, "n_before").join(count(after, "n_after")).join(count(runlog.lost_rows(before, after), "n_lost"))  # one row each
    return one.join(count(runlog.invalid_rows(after), "n_invalid"))


@query(f"{LOG} SELECT 2 * count(*) AS n_rows, true AS appended, true AS found_rewritten FROM log")
def run_log_parts(spark, sf_dir):
    """A log judged by its part files: appending breaks none, writing the log anew breaks every one."""
    path = _log(spark, sf_dir, times=1)
    known = stored(runlog.part_digests(spark, path), "parts")
    runlog.append_runs(run_rows(spark, sf_dir), path)
    appended = runlog.broken_parts(spark, path, known).isEmpty()
    every = stored(runlog.part_digests(spark, path, known), "parts")
    n = runlog.read_runs(spark, path).count()
    stored(runlog.read_runs(spark, path), "log").write.mode("overwrite").parquet(path)
    broken = runlog.broken_parts(spark, path, every).count()
    return spark.createDataFrame([(n, appended, broken == every.count())], "n_rows long, appended boolean, found_rewritten boolean")


@query(f"{LOG} SELECT run_id, config_hash FROM log")
def config_hash(spark, sf_dir):
    rows = b.scored_orders(spark, sf_dir).select("baseline", "seed").distinct()
    text = F.to_json(F.struct("seed", F.struct(F.lit(55).alias("train_max"), F.lit(56).alias("test_min"), F.lit(80).alias("test_max")).alias("split"), F.lit("orders").alias("model"), "baseline"))
    return rows.select(F.concat(F.lit("orders-"), "baseline", F.lit("-"), F.col("seed").cast("string")).alias("run_id"), scalar.config_hash_json(text).alias("config_hash"))


def _graph(spark, sf_dir):
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    n = b.order_features(spark, sf_dir)
    n.select("tx_id", "time_step", *[F.col("features")[i].alias(f"f{i}") for i in range(5)]).write.csv(f"{path}/features")
    b.order_classes(spark, sf_dir).select(F.col("tx_id").alias("txId"), "class").write.option("header", True).csv(f"{path}/classes")
    b.order_edges(spark, sf_dir).select(F.col("src").alias("txId1"), F.col("dst").alias("txId2")).write.option("header", True).csv(f"{path}/edges")
    return graph.load_graph(spark, f"{path}/features", f"{path}/classes", f"{path}/edges")


@query(f"WITH {ORDERS}, {FEATURES} SELECT tx_id, time_step, y, y <> -1 AS labelled, {', '.join(f'round(CAST(f{i} AS FLOAT)::DOUBLE, 2) AS f{i}' for i in range(5))} FROM f")
def graph_file_nodes(spark, sf_dir):
    """The nodes of the three CSV files, with what they hold."""
    loaded, _ = _graph(spark, sf_dir)
    return loaded.select("tx_id", "time_step", "y", "labelled", *[F.round(F.col("features")[i].cast("double"), 2).alias(f"f{i}") for i in range(5)])


@query(f"WITH {ORDERS}, {EDGES} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def graph_file_edges(spark, sf_dir):
    """The edges of the three CSV files, in both directions."""
    return _graph(spark, sf_dir)[1].select("src", "dst")


@query(f"WITH {ORDERS}, {EDGES} SELECT kind, n FROM (SELECT 'nodes' AS kind, count(*) AS n FROM o UNION ALL SELECT 'labelled', count(*) FROM o WHERE y <> -1 UNION ALL SELECT 'edges', 2 * count(*) FROM e)")
def graph_files(spark, sf_dir):
    """Tables written as the three CSV files and loaded again."""
    loaded, e = _graph(spark, sf_dir)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(loaded, "nodes").unionByName(count(loaded.filter("labelled"), "labelled")).unionByName(count(e, "edges"))
