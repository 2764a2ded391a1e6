import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def barbell(spark):
    from roadloom.graph import RoadGraph, graph_of
    from roadloom.storage import checkpoint

    edges = [(a, b, 1.0) for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3))]
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "node_id long, x double, y double")
    g = graph_of(nodes, spark.createDataFrame(edges, "u long, v long, length_m double"))
    return RoadGraph(checkpoint(g.nodes), checkpoint(g.edges))


def ids(spark, *nodes):
    return spark.createDataFrame([("g", n) for n in nodes], "graph_id string, node_id long")


def test_states_and_clicks(spark, barbell):
    from roadloom.operators import scenarios as s
    from roadloom.operators.kernels import cut_structure
    from roadloom.operators.paths import betweenness

    nodes, edges = cut_structure(barbell)
    nodes = nodes.withColumn("is_critical", F.col("node_id") == 4)
    scores = betweenness(barbell).withColumnRenamed("betweenness", "score")
    states = {(r["u"], r["v"]): r["state"] for r in s.edge_states(edges, scores, ids(spark, 0)).collect()}
    assert states[(0, 1)] == "disabled" and states[(2, 3)] == "critical_bridge" and states[(3, 4)] == "observed"
    assert {r["node_id"]: r["state"] for r in s.node_states(nodes, ids(spark, 0), 4).collect()} == {0: "disabled", 2: "articulation", 3: "articulation", 4: "selected"}
    assert s.clicked_node(nodes, 4.0001, 0.0).first()["node_id"] == 4 and s.clicked_node(nodes, 3.0, 0.0).count() == 0
    assert s.drawn_nodes(nodes, [[(0.5, -1), (2, -1), (2, 1), (0.5, 1)], [(3.5, -1), (4.5, -1), (4.5, 1), (3.5, 1)]]).first()["nodes"] == [1, 4]


def test_failure_paths_and_memory(spark, barbell):
    from roadloom.operators import scenarios as s
    from roadloom.operators.paths import betweenness

    r = s.failure(barbell, ids(spark, 2)).first()
    assert r["largest_cc_fraction"] == pytest.approx(3 / 5) and 0 < r["resilience_index"] < 1
    paths = spark.createDataFrame([("g", [0, 2, 3]), ("g", [4])], "graph_id string, path array<long>")
    assert sorted(r["length"] for r in s.path_length(paths, barbell).collect()) == [0.0, 2.0]
    cache = s.ScoreCache()
    first, again = cache.get(barbell, betweenness), cache.get(barbell, betweenness)
    assert first is again and cache.hits == 1


def test_dataset_plans(spark):
    from roadloom.plans import datasets as d

    edges = spark.createDataFrame([(10, 20, 5.0), (20, 10, 3.0), (20, 20, 1.0), (20, 30, 2.0)], "u long, v long, length_m double")
    _, simple = d.truth_graph_edges(edges)
    assert sorted(map(tuple, simple.collect())) == [(0, 1, 3.0), (1, 2, 2.0)]
    pixels = spark.createDataFrame([("m", r, c) for r in range(4) for c in range(4)] + [("m", 9, 9)], "mask_id string, row int, col int")
    m = d.manifest(pixels, 4).first()
    assert m["n_tiles"] == 2 and m["densest"]["road_px"] == 16
    assert d.upsampled_tiles(pixels, 2.0, 40, 40, 8, 0.1).count() == 1
    road = spark.createDataFrame([("m", [(1.0, 1.0), (8.0, 1.0)])], "mask_id string, geometry array<struct<x:double,y:double>>")
    from roadloom.operators.raster import rasterized

    rows = {r["row"] for r in rasterized(d.line_segments(road), 1.0).collect()}
    assert rows == {0, 1}


def test_splits(spark):
    from roadloom.operators import splits as s

    chips = spark.createDataFrame([(f"sn_chip{i % 10}_r{i}",) for i in range(40)], "name string").withColumn("chip", s.chip_name(F.col("name")))
    out = s.holdout(chips, "chip", 0.2, 17)
    assert out.where("split = 'test'").count() == 2 and out.count() == 10
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, s.holdout(chips, "chip", 0.2, 17).collect()))
    files = spark.createDataFrame([("/d/a_sat.jpg",), ("/d/a_mask.png",), ("/d/b_sat.jpg",)], "path string")
    assert [r["stem"] for r in s.image_pairs(files).collect()] == ["a"]
    flags = spark.createDataFrame([("True",), ("yes",), ("0",), (None,)], "f string").select(s.truthy(F.col("f")).alias("t"))
    assert [r["t"] for r in flags.collect()] == [True, True, False, False]


def test_registered_reports_take_as_many_removals_as_the_reference(monkeypatch):
    from roadloom import queries
    from roadloom.plans import pipelines

    taken = {}
    monkeypatch.setattr(queries, "roads", lambda spark, sf_dir: None)
    monkeypatch.setattr(queries.paths, "betweenness", lambda g: None)
    monkeypatch.setattr(pipelines, "graph_report", lambda g, steps=40: taken.update(report=steps))
    monkeypatch.setattr(pipelines, "ablation_table", lambda g, scores, steps=25: taken.update(ablation=steps))
    queries.road_graph_report(None, "")
    queries.road_ablation_curves(None, "")
    assert taken == {"report": 40, "ablation": 25}


def test_scores_are_ranked_before_they_are_rounded(spark):
    from roadloom.graph import RoadGraph
    from roadloom.plans.pipelines import rank_table

    nodes = spark.createDataFrame([("g", i, i) for i in range(4)], "graph_id string, node_id long, ord int")
    scores = [(0, 0.25), (1, 0.25 + 1e-8), (2, 0.25 + 2e-8), (3, 0.25 + 1e-15)]
    ranked = rank_table(RoadGraph(nodes, None), spark.createDataFrame([("g", *s) for s in scores], "graph_id string, node_id long, betweenness double"), 0.5)
    got = {r["node_id"]: (r["rank"], r["is_critical"], r["betweenness"]) for r in ranked.collect()}
    assert got == {2: (1, True, 0.25), 1: (2, True, 0.25), 0: (3, False, 0.25), 3: (4, False, 0.25)}  # 0 and 3 tie


def test_spurs_of_no_length_stay(spark):
    from roadloom.operators.raster import without_spurs

    pixels = spark.createDataFrame([("m", 0, c) for c in range(5)] + [("m", 1, 2)], "mask_id string, row int, col int")
    assert without_spurs(pixels, 0).count() == 6


def test_moving_average_after_every_row(spark):
    from roadloom.operators.splits import moving_average

    rows = [("a", 1, 4.0), ("a", 2, 8.0), ("a", 3, 0.0), ("b", 1, 1.0)]
    got = moving_average(spark.createDataFrame(rows, "k string, step int, v double"), "step", "v", "k", 0.75).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 4.0), ("a", 2, 5.0), ("a", 3, 3.75), ("b", 1, 1.0)]
