"""Known answers on small graphs."""

import math

import pytest
from pyspark.sql import functions as F


def graph(spark, edges, places=None, graph_id="g"):
    from roadloom.graph import graph_of

    ids = sorted({x for e in edges for x in e[:2]} | set(places or {}))
    nodes = spark.createDataFrame([(i, *map(float, (places or {}).get(i, (i, 0)))) for i in ids], "node_id long, x double, y double").withColumn("graph_id", F.lit(graph_id))
    rows = [(e[0], e[1], float(e[2]) if len(e) > 2 else None, bool(e[3]) if len(e) > 3 else False) for e in edges]
    df = spark.createDataFrame(rows, "u long, v long, length_m double, is_bridged boolean").withColumn("graph_id", F.lit(graph_id))
    if rows and rows[0][2] is None:
        df = df.drop("length_m")
    return graph_of(nodes, df)


BARBELL = [(a, b, 1.0) for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3))]


def removed(spark, *ids):
    return spark.createDataFrame([("g", i) for i in ids], "graph_id string, node_id long")


def test_efficiency(spark):
    from roadloom.operators.paths import efficiency

    value = lambda g, **o: efficiency(g, **o).first()["efficiency"]
    assert value(graph(spark, [(0, 1, 1.0), (1, 2, 1.0)])) == pytest.approx(5 / 6)
    assert value(graph(spark, [(0, 1, 1.0), (1, 2, 1.0)]), k=9) == pytest.approx(5 / 6)
    assert value(graph(spark, [], {0: (0, 0), 1: (1, 0)})) == 0.0
    assert value(graph(spark, [], {0: (0, 0)})) == 0.0
    for k in (0, -1):
        with pytest.raises(ValueError):
            efficiency(graph(spark, BARBELL), k=k)


def test_resilience(spark):
    from roadloom.operators.paths import resilience

    r = resilience(graph(spark, [(0, 1, 1.0), (1, 2, 1.0)]), removed(spark, 1)).first()
    assert r["resilience_index"] == 0.0 and math.isinf(r["travel_time_delta_pct"])
    r = resilience(graph(spark, BARBELL), removed(spark, 2)).first()
    assert r["largest_cc_fraction"] == pytest.approx(3 / 5)


def test_betweenness_of_a_path(spark):
    from roadloom.operators.paths import betweenness

    got = {r["node_id"]: r["betweenness"] for r in betweenness(graph(spark, [(i, i + 1, 1.0) for i in range(4)])).collect()}
    assert got == pytest.approx({0: 0, 1: 0.5, 2: 2 / 3, 3: 0.5, 4: 0})


def test_uniform_percolation_is_betweenness(spark):
    from roadloom.operators.paths import betweenness, percolation

    g = graph(spark, BARBELL)
    states = g.nodes.select("graph_id", "node_id", F.lit(1.0).alias("state"))
    a = {r["node_id"]: r["betweenness"] for r in betweenness(g).collect()}
    b = {r["node_id"]: r["percolation"] for r in percolation(g, states).collect()}
    assert a == pytest.approx(b)


def test_pivots_rank_as_all_sources(spark):
    from roadloom.operators.paths import betweenness
    from roadloom.operators.scoring import centrality_comparison
    from roadloom.sources.files import grid_graph

    g = grid_graph(spark, 15)
    a = betweenness(g).withColumnRenamed("betweenness", "a")
    b = betweenness(g, k=80).withColumnRenamed("betweenness", "b")
    both = g.nodes.select("graph_id", "node_id", "ord").join(a, ["graph_id", "node_id"]).join(b, ["graph_id", "node_id"])
    assert centrality_comparison(both).first()["spearman"] > 0.9


def test_cut_structure(spark):
    from roadloom.operators.kernels import cut_structure

    nodes, edges = cut_structure(graph(spark, BARBELL))
    assert {r["node_id"] for r in nodes.where("is_articulation").collect()} == {2, 3}
    assert [(r["u"], r["v"]) for r in edges.where("is_bridge").collect()] == [(2, 3)]
    nodes, edges = cut_structure(graph(spark, BARBELL + [(10, 11, 1.0)]))
    assert edges.where("is_bridge").count() == 2
    nodes, edges = cut_structure(graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0)]))
    assert nodes.where("is_articulation").count() == edges.where("is_bridge").count() == 0


def gap_graph(spark, gap):
    return graph(spark, [(0, 1), (2, 3)], {0: (0, 0), 1: (10, 0), 2: (10 + gap, 0), 3: (20 + gap, 0)})


def test_healing(spark):
    from roadloom.operators.topology import heal

    g, report = heal(gap_graph(spark, 10))
    bridge = g.edges.where("is_bridged").first()
    assert (bridge["u"], bridge["v"]) == (1, 2) and bridge["length_m"] == pytest.approx(10)
    r = report.first()
    assert (r["bridges_added"], r["components_before"], r["components_after"], r["connectivity_gain_pct"]) == (1, 2, 1, 100.0)
    assert {r["node_id"] for r in g.nodes.where("type = 'bridged'").collect()} == {1, 2}
    for reach, n in ((40, 0), (60, 1)):
        assert heal(gap_graph(spark, 50), gap=reach)[0].edges.where("is_bridged").count() == n
    sharp = graph(spark, [(0, 1), (2, 3)], {0: (0, 0), 1: (10, 0), 2: (10, 5), 3: (10, 40)})
    for angle, n in ((60, 0), (100, 1)):
        assert heal(sharp, max_angle=angle)[0].edges.where("is_bridged").count() == n


def test_pruning_and_collapsing(spark):
    from roadloom.operators.kernels import collapse_degree2, simplify
    from roadloom.operators.topology import prune_degenerate, prune_stubs

    chain = graph(spark, [(i, i + 1) for i in range(5)], {i: (10 * i, 0) for i in range(6)})
    done = collapse_degree2(chain)
    e = done.edges.first()
    assert (e["u"], e["v"], e["length_m"], len(e["geometry"])) == (0, 5, 50.0, 6)
    assert {r["node_id"] for r in done.nodes.collect()} == {0, 5}
    triangle = graph(spark, [(0, 1), (1, 2), (0, 2)], {0: (0, 0), 1: (10, 0), 2: (5, 8)})
    assert collapse_degree2(triangle).edges.count() == 3
    degenerate = graph(spark, [(0, 1), (3, 4)], {0: (0, 0), 1: (10, 0), 3: (30, 0), 4: (30.3, 0)})
    kept = prune_degenerate(degenerate, 0.5)
    assert kept.edges.count() == 1 and {r["node_id"] for r in kept.nodes.collect()} == {0, 1}
    stub = graph(spark, [(0, 1, 50.0), (1, 2, 3.0), (1, 3, 40.0)])
    assert {r["node_id"] for r in prune_stubs(stub, 15).nodes.collect()} == {0, 1, 3}
    _, report = simplify(stub, 15)
    r = report.first()
    assert (r["stubs_removed"], r["nodes_collapsed"]) == (1, 1)


def test_consolidation(spark):
    from roadloom.operators.topology import consolidate

    near = graph(spark, [(0, 1), (0, 2), (1, 3)], {0: (0, 0), 1: (1, 0), 2: (-20, 0), 3: (21, 0)})
    done = consolidate(near, 10)
    assert {(r["node_id"], r["x"]) for r in done.nodes.collect()} == {(0, 0.5), (2, -20.0), (3, 21.0)}
    assert {(r["u"], r["v"]) for r in done.edges.collect()} == {(0, 2), (0, 3)}
    overpass = graph(spark, [(0, 1), (2, 3)], {0: (5, 5), 1: (5.5, 5), 2: (5, 5.3), 3: (5.5, 5.3)})
    assert consolidate(overpass, 2).nodes.count() == 2  # nearness alone never merges


def test_reroute(spark):
    from roadloom.operators.paths import reroutes

    square = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 3, 2.0), (3, 2, 2.0)])
    r = reroutes(square, removed(spark, 1)).first()
    assert (r["origin"], r["destination"], r["rerouted_path"], r["travel_time_delta_pct"]) == (0, 2, [0, 3, 2], 100.0)
    cut = reroutes(graph(spark, [(0, 1, 1.0), (1, 2, 1.0)]), removed(spark, 1)).first()
    assert cut["rerouted_path"] is None and math.isinf(cut["travel_time_delta_pct"])


def test_apls(spark):
    from roadloom.operators.paths import apls

    line = lambda n: graph(spark, [(i, i + 1, 111.32) for i in range(n)], {i: (73.82 + 0.001 * i, 15.49) for i in range(n + 1)})
    assert apls(line(5), line(5), samples=60).first()["apls"] == pytest.approx(1.0)
    part = apls(line(5), line(2), samples=60).first()
    assert 0 < part["apls"] < 1 and part["proposal_to_truth"] == pytest.approx(1.0)


def test_many_graphs_at_once(spark):
    from roadloom.graph import RoadGraph, violations
    from roadloom.operators.paths import betweenness, efficiency

    a, b = graph(spark, BARBELL, graph_id="a"), graph(spark, [(0, 1, 1.0), (1, 2, 1.0)], graph_id="b")
    both = RoadGraph(a.nodes.unionByName(b.nodes), a.edges.unionByName(b.edges))
    assert {r["graph_id"]: r["n"] for r in efficiency(both).collect()} == {"a": 6, "b": 3}
    assert betweenness(both).count() == 9 and violations(both).count() == 0


def test_files(spark, tmp_path):
    from roadloom.sources.files import graph_from_features, read_features, read_graphml, read_masks, mask_pngs, write_geojson, write_graphml

    g = graph(spark, [(0, 1), (1, 2)], {0: (0, 0), 1: (3, 4), 2: (6, 8)})
    write_graphml(g, f"{tmp_path}/g.graphml")
    write_geojson(g, f"{tmp_path}/g.geojson", {"heal": {"n": 1}})
    for back in (read_graphml(spark, f"{tmp_path}/g.graphml"), graph_from_features(read_features(spark, f"{tmp_path}/g.geojson"))):
        assert sorted((r["u"], r["v"], r["length_m"]) for r in back.edges.collect()) == [(0, 1, 5.0), (1, 2, 5.0)]
        assert back.nodes.count() == 3
    pixels = spark.createDataFrame([("m", 1, 2), ("m", 0, 0)], "mask_id string, row int, col int")
    png = mask_pngs(pixels, spark.createDataFrame([("m", 3, 4)], "mask_id string, height int, width int")).first()["png"]
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "m.png").write_bytes(bytes(png))
    assert sorted(map(tuple, read_masks(spark, f"file://{tmp_path}/pics").collect())) == [("m", 0, 0), ("m", 1, 2)]


def test_mask_to_graph(spark):
    from roadloom.plans.pipelines import build_graph

    pixels = [("m", r, c) for k in (40, 80, 120) for t in range(20, 141) for d in (-1, 0, 1) for r, c in ((k + d, t), (t, k + d))]
    df = spark.createDataFrame(sorted(set(pixels)), "mask_id string, row int, col int").where("not (row between 39 and 41 and col between 78 and 91)")
    g = build_graph(df, min_stub=5.0, merge=5.0)
    from roadloom.operators.topology import component_summary, components

    assert component_summary(components(g.nodes, g.edges)).first()["n_components"] == 1
    assert g.edges.count() >= 12


def test_spread_and_closing(spark):
    from roadloom.operators import raster

    px = spark.createDataFrame([("m", r, c) for r in (4, 5, 6) for c in range(10) if c != 4] + [("m", 20, 20)], "mask_id string, row int, col int")
    assert ("m", 5, 4) in set(map(tuple, raster.closed(px, 1).collect()))
    assert raster.without_small(px, 2).count() == 27
    assert ("m", 20, 20) not in set(map(tuple, raster.opened(px, 1).collect()))
    values = spark.range(16).selectExpr("'i' img", "cast(id / 4 as int) row", "cast(id % 4 as int) col", "cast(id as double) p")
    same = raster.undone_dihedral(raster.dihedral(values, 4), 4)
    assert same.join(values.withColumnRenamed("p", "q"), ["img", "row", "col"]).where("abs(p - q) < 1e-12").count() == 16


def test_closure_stream(spark, tmp_path):
    from roadloom.streaming.closures import closure_stream

    rows = [("a", "2026-01-01 00:00:00", "close", [1, 2]), ("a", "2026-01-01 00:01:00", "close", [3]), ("b", "2026-01-01 00:00:00", "reset", None)]
    events = spark.createDataFrame(rows, "graph_id string, at string, action string, nodes array<long>").withColumn("at", F.to_timestamp("at"))
    events.write.parquet(f"{tmp_path}/events")
    stream = closure_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    q = stream.writeStream.format("memory").queryName("closed_now").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["graph_id"]: r["nodes"] for r in spark.table("closed_now").collect()} == {"a": [3], "b": []}
