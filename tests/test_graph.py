"""Sources, nodes, edges, split and the inductive subgraph on small hand-made graphs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgraph.operators import checks, edges, hubs, inductive, nodes, split
from ledgraph.sources import graph
from ledgraph.sources.store import bucketed

SPLIT = split.TemporalSplit(34, 35, 49)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "features.csv").write_text("100,1,0.1,0.2,0.3\n200,34,0.4,0.5,0.6\n300,35,0.7,0.8,0.9\n400,49,1.0,1.1,1.2\n")
    (tmp_path / "classes.csv").write_text("txId,class\n100,1\n200,2\n300,unknown\n400,1\n")
    (tmp_path / "edges.csv").write_text("txId1,txId2\n100,200\n300,400\n")
    return [str(tmp_path / f"{x}.csv") for x in ("features", "classes", "edges")]


def test_load_graph(spark, files):
    n, e = graph.load_graph(spark, *files)
    rows = {r.tx_id: r for r in n.collect()}
    assert [rows[k].time_step for k in (100, 200, 300, 400)] == [1, 34, 35, 49]
    assert [rows[k].y for k in (100, 200, 300, 400)] == [1, 0, -1, 1]
    assert [rows[k].labelled for k in (100, 200, 300, 400)] == [True, True, False, True]
    assert rows[100].features == pytest.approx([0.1, 0.2, 0.3])
    assert e.count() == 4
    assert graph.load_graph(spark, *files, symmetrise=False)[1].count() == 2


def test_strict_dimensions(spark, files):
    graph.load_graph(spark, *files, strict={"n_nodes": 4, "n_steps": 4, "max_step": 49, "n_features": 3})
    with pytest.raises(AssertionError, match="n_nodes is 4"):
        graph.load_graph(spark, *files, strict={})


def test_profile_of_nothing(spark):
    row = checks.dataset_profile(spark.createDataFrame([], "tx_id long, time_step int, features array<float>")).first()
    assert (row.n_nodes, row.n_steps, row.max_step) == (0, 0, None)


def test_labels(spark):
    n = spark.createDataFrame([(1,), (2,), (3,), (4,)], "tx_id long")
    c = spark.createDataFrame([(1, "1", 0), (1, "2", 1), (2, "x", 0), (3, None, 0), (9, "1", 0)], "tx_id long, class string, pos int")
    with pytest.raises(ValueError, match="several classes"):
        nodes.attach_labels(n, c)
    found = {r.tx_id: (r.y, r.labelled) for r in nodes.attach_labels(n, c, "pos").collect()}
    assert found == {1: (0, True), 2: (-1, False), 3: (-1, False), 4: (-1, False)}
    assert {(r.y, r.n) for r in nodes.label_profile(nodes.attach_labels(n, c, "pos")).collect()} == {(0, 1), (-1, 3)}


def test_node_index(spark):
    n = spark.range(1000, 0, -7).withColumnRenamed("id", "tx_id")
    index = {r.tx_id: r.node_idx for r in nodes.assign_node_index(n).collect()}
    assert index == {k: i for i, k in enumerate(sorted(range(1000, 0, -7)))}
    twice = spark.createDataFrame([(7, 0), (8, 1), (7, 2)], "tx_id long, pos int")
    assert {(r.tx_id, r.node_idx) for r in nodes.assign_node_index(twice, order_col="pos").collect()} == {(7, 2), (8, 1)}


def test_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (4, 1)], "src long, dst long")
    assert {tuple(r) for r in edges.symmetrise_edges(e).collect()} == {(1, 2), (2, 1), (3, 3), (4, 1), (1, 4)}
    assert edges.symmetrise_edges(e).count() == 5
    n = spark.createDataFrame([(1,), (2,), (3,)], "tx_id long")
    assert [tuple(r) for r in edges.dangling_edges(e, n).collect()] == [(4, 1)]
    with pytest.raises(ValueError, match="1 edge endpoints"):
        edges.assert_no_dangling(e, n)
    null = spark.createDataFrame([(1, None)], "src long, dst long")
    assert edges.dangling_edges(null, n).count() == edges.dangling_endpoints(null, n).count() == 1
    index = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "tx_id long, node_idx long")
    assert sorted(tuple(r) for r in edges.remap_edges(e, index).collect()) == [(0, 1), (0, 1), (1, 0), (2, 2)]


def test_split_bounds():
    split.TemporalSplit(34, 35, 49)
    for bad in ((34, 34, None), (34, 33, None), (34, 40, 39)):
        with pytest.raises(ValueError):
            split.TemporalSplit(*bad)
    assert split.TemporalSplit(34, 35, 49).test_window == "35-49"
    assert split.TemporalSplit(34, 35).test_window == "35-end"


def test_split_masks(spark):
    n = spark.range(1, 50).selectExpr("id AS tx_id", "CAST(id AS INT) AS time_step")
    rows = split.split_masks(n, split.TemporalSplit(34, 35, 49)).collect()
    assert sum(r.train_mask for r in rows) == 34 and sum(r.test_mask for r in rows) == 15
    assert not any(r.train_mask and r.test_mask for r in rows)
    gap = split.split_masks(n, split.TemporalSplit(10, 20, 30)).collect()
    assert {r.time_step for r in gap if not r.train_mask and not r.test_mask} == {*range(11, 20), *range(31, 50)}
    none = split.split_masks(spark.createDataFrame([(1, None)], "tx_id long, time_step int"), split.TemporalSplit(1, 2)).first()
    assert none.train_mask is False and none.test_mask is False


def test_split_by_date(spark):
    n = spark.sql("SELECT * FROM VALUES (1, DATE'2020-01-01'), (2, DATE'2020-02-01'), (3, DATE'2020-03-01') AS t(tx_id, filed)")
    rows = split.split_masks(n, split.TemporalSplit(date(2020, 1, 15), date(2020, 2, 15), None, "filed")).orderBy("tx_id").collect()
    assert [(r.train_mask, r.test_mask) for r in rows] == [(True, False), (False, False), (False, True)]


@pytest.fixture
def crossing(spark):
    n = spark.createDataFrame([(0, 30), (1, 34), (2, 35), (3, 40)], "tx_id long, time_step int")
    return n, spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")


def test_induced_subgraph(crossing):
    n, e = crossing
    s = split.TemporalSplit(34, 35, 49)
    inside = inductive.induced_train_subgraph(e, n, s)
    assert [tuple(r) for r in inside.collect()] == [(0, 1)]
    assert [r.tx_id for r in inductive.train_nodes(n, s).filter("train_mask").orderBy("tx_id").collect()] == [0, 1]
    inductive.assert_no_leakage(inside, n, s)
    with pytest.raises(AssertionError, match="2 edges"):
        inductive.assert_no_leakage(e, n, s)


def test_gap_edges_leak_and_are_not_induced(crossing):
    n, e = crossing
    s = split.TemporalSplit(33, 36)
    assert inductive.induced_train_subgraph(e, n, s).count() == 0
    assert inductive.leakage_report(e, n, s).first().n_leaking == 3


def test_unknown_times_leak(spark, crossing):
    n, _ = crossing
    e = spark.createDataFrame([(0, 99), (0, None), (0, 0), (0, 0)], "src long, dst long")
    s = split.TemporalSplit(34, 35)
    assert inductive.leakage_report(e, n, s).first().n_leaking == 2
    assert inductive.induced_train_subgraph(e, n, s).count() == 2
    assert inductive.edge_endpoint_times(e, n).count() == 4


def test_local_features(spark):
    n = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],), (None,)], "features array<float>")
    assert [r.features for r in split.local_features(n, 2).collect()] == [[1.0, 2.0], [], None]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df) -> str:
    """The exchanges of a plan and what stands below them, line by line."""
    lines, out, depth = plan_of(df).splitlines(), [], None
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "Exchange" in line:
            depth = at
        if depth is not None:
            out.append(line)
    return "\n".join(out)


def test_labels_join_without_moving_features(spark):
    wide = spark.range(300).select(F.col("id").alias("tx_id"), F.lit(1).alias("time_step"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("features"))
    classes = spark.range(0, 300, 2).select(F.col("id").alias("tx_id"), F.lit("1").alias("class"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = bucketed(wide, "tx_id", "wide")
        found = nodes.attach_labels(held, classes, order_col="class")
        assert "Exchange" in plan_of(found) and "features" not in exchanged(found)
        assert "features" in exchanged(nodes.attach_labels(wide, classes, order_col="class"))
        rows = {r.tx_id: (r.y, r.features[1]) for r in found.collect()}
        assert rows == {i: (1 if i % 2 == 0 else -1, float(i)) for i in range(300)}
        # The ends' times come from it without moving its rows either.
        e = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        assert "features" not in exchanged(inductive.edge_endpoint_times(e, held)) and inductive.edge_endpoint_times(e, held).count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def hub_graph(spark):
    """60,000 edges; one id begins half of them, and a sixth have no begin."""
    src = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.col("id") % 900)
    e = spark.range(60_000, numPartitions=6).select(src.cast("long").alias("src"), (F.col("id") % 1100).alias("dst"))
    n = spark.range(1000).select(F.col("id").alias("tx_id"), (F.col("id") % 50).cast("int").alias("time_step"))
    return e, n


def test_hubs_are_dealt_to_parts(spark):
    e, n = hub_graph(spark)
    assert {(r["_hub"], r["_salts"]) for r in hubs.hub_ids(e, "src", 2_000).collect()} == {(7, 15), (None, 5)}
    assert hubs.hub_ids(e, "dst", 2_000) is None and hubs.hub_ids(e.limit(0), "src", 10) is None
    count = lambda df: sorted(map(str, df.collect()))
    assert count(inductive.edge_endpoint_times(e, n, hub_rows=2_000)) == count(inductive.edge_endpoint_times(e, n))
    assert count(inductive.induced_train_subgraph(e, n, SPLIT, 2_000)) == count(inductive.induced_train_subgraph(e, n, SPLIT))
    index = n.select("tx_id", (F.col("tx_id") + 5).alias("node_idx"))
    assert count(edges.remap_edges(e, index, 2_000)) == count(edges.remap_edges(e, index))


def test_no_task_has_a_whole_hub(spark):
    """Rows a partition of the joined rows, dealt to 32 by a shuffle: with the hub in one task it were 30,000 at least."""
    e, n = hub_graph(spark)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        src = n.select(F.col("tx_id").alias("src"), "time_step")
        most = lambda rows: hubs.join_end(e, src, "src", "left", rows).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most(None) >= 30_000 and most(2_000) < 10_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_induced_edges_and_leaks_from_one_join(spark):
    e, n = hub_graph(spark)
    inside, seen = inductive.induced_and_leakage(e, n, SPLIT)
    rows = sorted(map(str, inside.collect()))
    assert rows == sorted(map(str, inductive.induced_train_subgraph(e, n, SPLIT).collect()))
    assert seen.get == inductive.leakage_report(e, n, SPLIT).first().asDict()


def test_dangling_edges_do_not_move_edges(spark):
    e, n = hub_graph(spark)
    found = edges.dangling_edges(e, n)
    want = [r for r in e.collect() if r.src is None or r.dst is None or r.dst >= 1000]
    assert sorted(map(str, found.collect())) == sorted(map(str, want)) and edges.dangling_edges(e.filter("src < 5 AND dst < 5"), n).count() == 0
    assert "Exchange hashpartitioning" not in plan_of(found)


def test_loading_reads_each_file_once(spark, tmp_path):
    (tmp_path / "f.csv").write_text("".join(f"{i},{i % 4},0.5,{i}\n" for i in range(40)))
    (tmp_path / "c.csv").write_text("txId,class\n" + "".join(f"{i},{i % 3}\n" for i in range(40)))
    (tmp_path / "e.csv").write_text("txId1,txId2\n" + "".join(f"{i},{i + 1}\n" for i in range(39)))
    paths = [str(tmp_path / x) for x in ("f.csv", "c.csv", "e.csv")]
    n, e = graph.load_graph(spark, *paths, strict={"n_nodes": 40, "n_steps": 4, "max_step": 3, "n_features": 2})
    (tmp_path / "f.csv").unlink()
    (tmp_path / "e.csv").unlink()
    assert (n.count(), n.filter("labelled").count(), e.count(), n.agg(F.sum(F.col("features")[1])).first()[0]) == (40, 26, 78, sum(range(40)))
    (tmp_path / "f.csv").write_text("1,1,0.5,1\n2,1,0.5,2\n")
    (tmp_path / "e.csv").write_text("txId1,txId2\n1,2\n")
    with pytest.raises(AssertionError, match="n_nodes is 2, not 40; n_steps is 1, not 4"):
        graph.load_graph(spark, *paths, strict={"n_nodes": 40, "n_steps": 4, "max_step": 1, "n_features": 2})
