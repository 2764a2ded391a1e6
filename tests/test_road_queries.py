"""Registered road queries on small tables."""

import datetime

import pytest


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    at = lambda second: datetime.datetime(2026, 1, 1, 0, 0, second)
    rows = [(at(1), 7, "a", 1.0), (at(2), 8, "a", 1.0), (at(2), 9, "a", 1.0), (at(1), 5, "b", 1.0), (at(2), 6, "b", 0.0)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def test_last_closures(spark, events):
    from roadloom.queries import last_closures

    assert sorted(map(tuple, last_closures(spark, events).collect())) == [("a", 1, 9), ("b", 0, None)]


def random_graph(spark, n=60, m=75, seed=3):
    import random

    from roadloom.graph import graph_of

    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    nodes = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(n)], "node_id long, x double, y double")
    return graph_of(nodes, spark.createDataFrame([(u, v, float(rng.randint(1, 9))) for u, v in sorted(pairs)], "u long, v long, length_m double")), n, sorted(pairs)


def parts_of(nodes, pairs):
    label = {x: x for x in nodes}
    for _ in nodes:
        for u, v in pairs:
            if u in label and v in label:
                label[u] = label[v] = min(label[u], label[v])
    return len(set(label.values()))


@pytest.mark.parametrize("room", [1, 20, 1000])
def test_thinned_edges_have_the_same_cuts(spark, room):
    """Dense pieces shrink to two forests a task, and no cut node or bridge changes."""
    from roadloom.operators.kernels import cut_structure, thinned

    g, n, pairs = random_graph(spark, 40, 60)
    slim = [(r["u"], r["v"]) for r in thinned(g.edges.coalesce(2), room).collect()]
    for x in range(n):
        others = [y for y in range(n) if y != x]
        assert parts_of(others, pairs) == parts_of(others, slim)
    nodes, edges = cut_structure(g)
    whole = parts_of(range(n), pairs)
    assert {r["node_id"] for r in nodes.where("is_articulation").collect()} == {x for x in range(n) if parts_of([y for y in range(n) if y != x], pairs) > whole - (not any(x in p for p in pairs))}
    assert {(r["u"], r["v"]) for r in edges.where("is_bridge").collect()} == {p for p in pairs if parts_of(range(n), [q for q in pairs if q != p]) > whole}


def test_thinning_bounds_a_dense_graph(spark):
    from roadloom.operators.kernels import thinned

    every = spark.createDataFrame([("g", u, v) for u in range(60) for v in range(u + 1, 60)], "graph_id string, u long, v long").coalesce(1)
    assert thinned(every, 100).count() <= 2 * 59


def plain_distances(n, edges, source):
    import heapq

    near = {x: [] for x in range(n)}
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    done, queue = {}, [(0.0, source)]
    while queue:
        d, at = heapq.heappop(queue)
        if at not in done:
            done[at] = d
            for to, w in near[at]:
                heapq.heappush(queue, (d + w, to))
    return done


@pytest.mark.parametrize("lengths", [(1, 9), (0, 2)])
def test_blocks_of_sources_settle_and_cut_like_single_ones(lengths, monkeypatch):
    import random

    import numpy as np
    import pandas as pd

    from roadloom.operators import paths

    monkeypatch.setattr(paths, "TOGETHER", 7)
    rng = random.Random(5)
    edges = sorted({(*sorted(rng.sample(range(50), 2)), float(rng.randint(*lengths))) for _ in range(110)})
    edges = list({e[:2]: e for e in edges}.values())
    nodes, arcs = paths._numbered(pd.DataFrame(edges, columns=["u", "v", "w"]), "w")
    assert sorted(paths._by_place(arcs, np.arange(len(nodes))).tolist()) == list(range(len(nodes)))
    expect = lambda kept, s: [plain_distances(50, kept, int(nodes[s])).get(int(x), np.inf) for x in nodes]
    gone = [e for e in edges if 3 in e[:2] or 11 in e[:2]]
    for some, best in paths._distance_blocks(arcs, paths._by_place(arcs, np.arange(len(nodes)))):
        assert all(best[:, i].tolist() == expect(edges, s) for i, s in enumerate(some))
        total, plain = np.zeros(len(nodes)), np.zeros(len(nodes))
        paths._add_dependencies(arcs, some, best, np.ones(len(some)), total)
        near = [list(zip(arcs[1][a:b].tolist(), arcs[2][a:b].tolist())) for a, b in zip(arcs[0][:-1], arcs[0][1:])]
        for s in some.tolist():
            paths._add_dependencies_of_one(near, s, 1.0, plain)
        assert total == pytest.approx(plain)
        tail, now, kept = nodes[np.repeat(np.arange(len(nodes)), np.diff(arcs[0]))], (arcs[0], arcs[1], arcs[2].copy()), edges
        for away in [*(e[:2] for e in gone[:3]), (3, None), (11, None)]:  # single edges, then nodes with theirs
            hit = [(a, b) in (away, away[::-1]) or away[1] is None and away[0] in (a, b) for a, b in zip(tail.tolist(), nodes[arcs[1]].tolist())]
            kept = [e for e in kept if e[:2] != away and not (away[1] is None and away[0] in e[:2])]
            paths._cut(now, best, some, np.flatnonzero(hit))
            assert all(best[:, i].tolist() == expect(kept, s) for i, s in enumerate(some))


def test_soft_skeletons_of_ragged_images(spark):
    """As the table operators give it, with absent cells."""
    from pyspark.sql import functions as F

    from roadloom.operators import raster, scoring

    rows = [(i, r, c, ((r * 7 + c * 5 + i) % 11) / 10, (r + c) % 3 % 2) for i in (1, 2) for r in range(6) for c in range(3, 8) if (r * c + i) % 7]
    values = spark.createDataFrame(rows, "img long, row int, col int, p double, t int")

    def plain(values):
        image, skeleton = values.select("img", "row", "col", "p"), None
        for i in range(3):
            image = raster.soft_erode(image).localCheckpoint() if i else image
            delta = image.join(raster.soft_dilate(raster.soft_erode(image)).withColumnRenamed("p", "o"), ["img", "row", "col"]).select("img", "row", "col", F.greatest(F.col("p") - F.col("o"), F.lit(0.0)).alias("d"))
            skeleton = delta.withColumnRenamed("d", "p") if skeleton is None else skeleton.join(delta, ["img", "row", "col"]).select("img", "row", "col", (F.col("p") + F.greatest(F.col("d") - F.col("p") * F.col("d"), F.lit(0.0))).alias("p"))
        return {tuple(r)[:3]: r["p"] for r in skeleton.collect()}

    sp, st = plain(values), plain(values.withColumn("p", F.col("t").cast("double")))
    assert {tuple(r)[:3]: r["p"] for r in raster.soft_skeleton(values, 2).collect()} == pytest.approx(sp)
    for r in scoring.soft_cldice(values, 2).collect():
        mine = [x for x in rows if x[0] == r["img"]]
        precision = (sum(sp[x[:3]] * x[4] for x in mine) + 1) / (sum(sp[x[:3]] for x in mine) + 1)
        recall = (sum(st[x[:3]] * x[3] for x in mine) + 1) / (sum(st[x[:3]] for x in mine) + 1)
        assert r["cldice"] == pytest.approx(1 - 2 * precision * recall / (precision + recall))
