"""What the review's second round found."""

import pytest


def drawn_graph(spark, n=40, m=70, seed=3):
    import random

    from roadloom.graph import graph_of

    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    nodes = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(n)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(a, b, float(rng.randint(1, 9))) for a, b in pairs], "u long, v long, length_m double")
    return graph_of(nodes, edges)


def test_demand_report_finds_paths_once(spark, monkeypatch):
    """one pass gives what two gave."""
    from roadloom.operators import paths, scoring
    from roadloom.plans.pipelines import demand_report, spatial_demand

    graph = drawn_graph(spark)
    a = paths.betweenness(graph).withColumnRenamed("betweenness", "a")
    b = paths.percolation(graph, spatial_demand(graph, "se")).withColumnRenamed("percolation", "b")
    expected = scoring.centrality_comparison(graph.nodes.select("graph_id", "node_id", "ord").join(a, ["graph_id", "node_id"]).join(b, ["graph_id", "node_id"]), 5).first()
    passes, plain = [], paths.per_near_sources
    monkeypatch.setattr(paths, "per_near_sources", lambda *a, **k: passes.append(1) or plain(*a, **k))
    found = demand_report(graph, "se", 5).first()
    assert len(passes) == 1
    assert found["spearman"] == pytest.approx(expected["spearman"], abs=1e-4)
    assert (found["top_a"], found["top_b"], found["promoted"]) == (expected["top_a"], expected["top_b"], expected["promoted"])


def test_each_edge_is_looked_at_once(monkeypatch):
    """dependencies come from edges in pieces, whatever their size, and from every kind of worth at once."""
    import numpy as np
    import pandas as pd

    from roadloom.operators import paths

    monkeypatch.setattr(paths, "CELLS", 40)
    edges = pd.DataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 3, 1.0), (3, 2, 1.0), (2, 4, 5.0), (7, 8, 2.0)], columns=["u", "v", "w"])
    nodes, arcs = paths._numbered(edges, "w")
    total = np.zeros((len(nodes), 2))
    for some, best in paths._distance_blocks(arcs, np.arange(len(nodes))):
        paths._add_dependencies(arcs, some, best, np.column_stack((np.ones(len(some)), 2.0 * (some == 0))), total)
    assert total[:, 0].tolist() == [1.0, 2.0, 7.0, 2.0, 0.0, 0.0, 0.0]
    assert total[:, 1].tolist() == [0.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0]


def test_long_whole_lengths_stay_exact():
    """sums beyond single precision."""
    import numpy as np
    import pandas as pd

    from roadloom.operators import paths

    edges = pd.DataFrame([(i, i + 1, float((1 << 23) + i + 1)) for i in range(6)], columns=["u", "v", "w"])
    _, arcs = paths._numbered(edges, "w")
    (_, best), = paths._distance_blocks(arcs, np.array([0]))
    assert best[:, 0].tolist() == [0.0, *np.cumsum(edges["w"]).tolist()]


@pytest.mark.parametrize("options", [dict(min_size=6, close_radius=1, fill=4), dict(min_size=3, open_radius=1, close_radius=2, fill=9), dict(min_size=0, open_radius=1), dict(min_size=0, fill=6)])
def test_masks_are_cleaned_one_by_one(spark, monkeypatch, options):
    """as the operators on tables clean them, without rounds over all masks."""
    import random

    from roadloom.operators import raster

    rng = random.Random(4)
    rows = [(m, r, c) for m, share in (("a", 0.45), ("b", 0.6), ("c", 0.8)) for r in range(14) for c in range(11) if rng.random() < share]
    px = spark.createDataFrame([*rows, ("far", -3, 40), ("far", 50_000, 1_000_000)], "mask_id string, row int, col int")
    masks = spark.createDataFrame([("a", 14, 11), ("b", 10, 12), ("c", 16, 16), ("empty", 2, 1)], "mask_id string, height int, width int")
    plain = raster.closed(raster.opened(px, options.get("open_radius", 0)), options.get("close_radius", 0))
    plain = raster.without_small(plain, options["min_size"]) if options["min_size"] else plain
    plain = raster.filled_holes(plain, masks, options["fill"]) if "fill" in options else plain
    expected = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(raster, "components", None)
    found = raster.cleaned(px, masks, **options)
    assert found.dtypes == px.dtypes
    assert sorted(map(tuple, found.collect())) == expected


def test_segments_over_one_place(spark, monkeypatch):
    """cells that were found touched are passed over, and all others are found."""
    import random

    import numpy as np

    from roadloom.operators import raster

    rng = random.Random(2)
    lines = [tuple(rng.uniform(-3, 30) for _ in range(4)) for _ in range(40)] + [(5.0, 5.0, 5.0, 5.0), (4.0, 2.0, 4.0, 9.0)]

    def touched(x1, y1, x2, y2):
        return {(r, c) for r in range(25) for c in range(28) if raster.touches(*(np.array([v]) for v in (x1, y1, x2, y2, r, c)), 0.8, 1.0)[0]}

    expected = set().union(*(touched(*x) for x in lines))
    cells = raster.TouchedCells(0.8, 1.0, 25, 28)
    found = [(m, r, c) for some in cells.of(np.array(["m"] * 300 * len(lines), dtype=object), *np.tile(np.array(lines), (300, 1)).T) for m, r, c in zip(*some)]
    assert {x[1:] for x in found} == expected and len(found) == len(expected)
    monkeypatch.setattr(raster, "FOUND", 16)  # few places: cells come again and are made distinct
    monkeypatch.setattr(raster, "CELLS_AT_ONCE", 30)
    monkeypatch.setattr(raster, "ROWS_AT_ONCE", 7)
    cells = raster.TouchedCells(0.8, 1.0, 25, 28)
    found = [(m, r, c) for some in cells.of(np.array(["m", "n"] * (len(lines) // 2), dtype=object), *np.array(lines).T) for m, r, c in zip(*some)]
    assert set(found) == {(m, *p) for i, x in enumerate(lines) for p in touched(*x) for m in ("mn"[i % 2],)}
    rows = [("m" if i % 3 else None, *map(float, x)) for i, x in enumerate(lines)] + [("m", None, 1.0, 2.0, 3.0)]
    out = raster.rasterized(spark.createDataFrame(rows, "mask_id string, x1 double, y1 double, x2 double, y2 double"), 1.6, 1.0, 25, 28)
    assert out.dtypes == [("mask_id", "string"), ("row", "int"), ("col", "int")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted({("m" if i % 3 else None, *p) for i, x in enumerate(lines) for p in touched(*x)}, key=str)


def test_edges_travel_packed(monkeypatch):
    """packed edges give the arcs of the edges, in a few bytes each."""
    import random

    import numpy as np

    from roadloom.operators import paths

    rng = random.Random(6)
    for whole in (True, False):
        pairs = sorted({tuple(sorted(rng.sample(range(-40, 2000), 2))) for _ in range(30_000)}, key=lambda _: rng.random())
        u, v = (np.array(x) for x in zip(*pairs))
        w = np.array([float(rng.randint(1, 15_000)) if whole else rng.random() for _ in pairs])
        gone = np.where(w < 2000, w, 2.0**30)
        packs = [paths._pack(*(x[lo : lo + 7000] for x in (u, v, w, gone))) for lo in range(0, len(u), 7000)]
        if whole:
            assert len(paths._pack(u, v, w)) < 6 * len(u)
        nodes, (begins, head), values = paths._arcs_from(packs)
        tail = np.repeat(nodes, np.diff(begins))
        found = sorted(zip(tail.tolist(), nodes[head].tolist(), *(x.tolist() for x in values)))
        assert found == sorted([*zip(u.tolist(), v.tolist(), w.tolist(), gone.tolist()), *zip(v.tolist(), u.tolist(), w.tolist(), gone.tolist())])
        assert values[0].dtype == (np.float32 if whole else np.float64)


def test_large_graphs_in_few_blocks(spark, monkeypatch):
    """a block of a graph with many edges has many sources."""
    from pyspark.sql import functions as F

    from roadloom.operators import paths

    graph = drawn_graph(spark, 40, 90)
    sources = paths.sampled_sources(graph.nodes, None, 42)

    def blocks():
        import pandas as pd

        edges = graph.edges.select("graph_id", "u", "v", "length_m")
        out = paths.per_near_sources(sources, edges, lambda g, nodes, arcs, rows, numbers, more: pd.DataFrame({"n": [len(rows)]}), "n long", "length_m")
        return sorted(r["n"] for r in out.collect())

    exact = {r["node_id"]: r["betweenness"] for r in paths.betweenness(graph).collect()}
    assert len(blocks()) == 8 and sum(blocks()) == 40
    monkeypatch.setattr(paths, "LARGE", 50)
    assert blocks() == [20, 20]
    assert {r["node_id"]: r["betweenness"] for r in paths.betweenness(graph).collect()} == pytest.approx(exact)
    assert paths.efficiency(graph, k=10).select(F.count("efficiency")).first()[0] == 1


def test_only_the_overlap_is_searched_for_pre_tokens():
    """op3: the tokens of a chunk away from its ends are not looked at one by one."""
    tokenizers = pytest.importorskip("tokenizers")
    from roadloom.llm import token_count

    library = tokenizers.Tokenizer(tokenizers.models.BPE(vocab={c: i for i, c in enumerate(sorted(tokenizers.pre_tokenizers.ByteLevel.alphabet()))}, merges=[]))
    library.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    asked = []

    class Watched:
        def __init__(self, encoding):
            self.encoding = encoding

        def __len__(self):
            return len(self.encoding)

        def __getattr__(self, name):
            assert name in ("token_to_chars", "token_to_word"), name  # no lists of a whole chunk
            return lambda i: asked.append(i) or getattr(self.encoding, name)(i)

    class Library:
        def encode(self, text, **options):
            return Watched(library.encode(text, **options))

    text = "some wörds 12 and\n\n more  of them, " * 2000
    assert token_count.count_tokens(Library(), text) == len(library.encode(text, add_special_tokens=False))
    assert 0 < len(asked) < len(text) / 10


def test_ways_over_two_edges_are_not_shuffled(spark):
    """as path lengths give them, with one exchange for the neighbours."""
    from pyspark.sql import functions as F

    from roadloom.operators import scenarios

    graph = drawn_graph(spark, 12, 40)
    one, two = (graph.arcs().select("graph_id", F.col("src").alias(a), F.col("dst").alias(b)) for a, b in (("a", "m"), ("m", "b")))
    plain = scenarios.path_length(one.join(two, ["graph_id", "m"]).where("a < b").select("graph_id", F.array("a", "m", "b").alias("path")), graph)
    edges = graph.edges.localCheckpoint()
    out = scenarios.two_edge_ways(graph.with_edges(edges)).drop("graph_id")
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(tuple, out.collect())) == sorted((*r["path"], r["length"]) for r in plain.collect())


def plain_reroutes(edges, closed):
    """By definition: a search for each pair of neighbours, with and without the node."""
    import heapq

    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))

    def way(a, b, avoid=None):
        done, before, best, queue = {}, {}, {a: 0.0}, [(0.0, a)]
        while queue:
            d, at = heapq.heappop(queue)
            if at in done:
                continue
            done[at] = d
            for to, w in near[at]:
                if to != avoid and to not in done and (to not in best or d + w < best[to]):
                    best[to], before[to] = d + w, at
                    heapq.heappush(queue, (d + w, to))
        if b not in done:
            return None, None
        path = [b]
        while path[-1] != a:
            path.append(before[path[-1]])
        return path[::-1], done[b]

    out = {}
    for c in closed:
        ends = sorted(x for x, _ in near.get(c, ()))
        finite, cut = [], []
        for a, b in ((a, b) for a in ends for b in ends if a < b):
            path, base = way(a, b)
            if c in path and base > 0:
                new_path, new = way(a, b, c)
                if new_path:
                    finite.append((-100.0 * (new / base - 1), a, b, path, base, new_path, new))
                else:
                    cut.append((a, b, path, base, None, None))
        if finite:
            out[c] = min(finite, key=lambda x: x[:3])[1:]
        elif cut:
            out[c] = max(cut, key=lambda x: x[:2])
    return out


@pytest.mark.parametrize("wide", [1.0, 1.25])
def test_detours_without_a_search_for_each_pair(spark, monkeypatch, wide):
    """F16: road_reroutes; lengths of nought, ties, fractions, parts that a node cuts off."""
    import random

    from roadloom.graph import graph_of
    from roadloom.operators import detours, paths

    monkeypatch.setattr(detours, "WIDER", wide)  # a narrow search leaves more to the second one
    monkeypatch.setattr(paths, "shortest_paths", None)
    rng, edges, closed, expected = random.Random(8), [], [], {}
    for i in range(36):
        n = rng.randint(3, 25)
        length = (lambda: float(rng.randint(1, 9)), lambda: float(rng.randint(0, 2)), rng.random)[i % 3]
        own = {tuple(sorted(rng.sample(range(n), 2))): length() for _ in range(rng.randint(2, 3 * n))}
        own = [(u, v, w) for (u, v), w in own.items()]
        shut = [c for c in range(n) if rng.random() < 0.7]
        edges += [(f"g{i}", *e) for e in own]
        closed += [(f"g{i}", c) for c in shut]
        expected |= {(f"g{i}", c): x for c, x in plain_reroutes(own, shut).items()}
    nodes = spark.createDataFrame(sorted({(g, x) for g, u, v, _ in edges for x in (u, v)}), "graph_id string, node_id long")
    graph = graph_of(nodes, spark.createDataFrame(edges, "graph_id string, u long, v long, length_m double"))
    rows = paths.reroutes(graph, spark.createDataFrame(closed, "graph_id string, node_id long")).collect()
    found = {(r["graph_id"], r["node_id"]): (r["origin"], r["destination"], r["baseline_path"], r["baseline_length_m"], r["rerouted_path"], r["rerouted_length_m"]) for r in rows}
    assert len(rows) == len(found) > 100 and any(x[4] is None for x in found.values())
    assert found == expected


def test_shortest_paths_of_pairs(spark):
    """F10, F16: pairs without a way, of one node, of unknown nodes; edges travel packed."""
    from roadloom.operators import paths
    from roadloom.graph import graph_of

    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 3, 1.0), (3, 2, 1.0), (4, 5, 0.5), (2, 6, 0.0)], "u long, v long, length_m double")
    graph = graph_of(spark.createDataFrame([(i,) for i in range(8)], "node_id long"), edges)
    pairs = spark.createDataFrame([("g", 0, 2, 1), ("g", 2, 0, 3), ("g", 0, 4, 1), ("g", 7, 7, 1), ("g", 0, 7, 1), ("g", 0, 6, 5), ("g", 0, 1, 1)], "graph_id string, a long, b long, avoid long")
    at = lambda df: {(r["a"], r["b"]): (r["path"], r["length"]) for r in df.collect()}
    assert at(paths.shortest_paths(graph, pairs)) == {(0, 2): ([0, 1, 2], 2.0), (2, 0): ([2, 1, 0], 2.0), (0, 4): (None, None), (7, 7): ([7], 0.0), (0, 7): (None, None), (0, 6): ([0, 1, 2, 6], 2.0), (0, 1): ([0, 1], 1.0)}
    assert at(paths.shortest_paths(graph, pairs, without=True)) == {(0, 2): ([0, 3, 2], 2.0), (2, 0): ([2, 1, 0], 2.0), (0, 4): (None, None), (7, 7): ([7], 0.0), (0, 7): (None, None), (0, 6): ([0, 1, 2, 6], 2.0), (0, 1): (None, None)}


def plain_apls(truth, proposal, samples, tolerance, seed=42):
    """By definition, over graphs of all points: (nodes [(id, ord, x, y)], edges [(u, v, length)])."""
    import heapq
    import math
    import random

    x0, y0 = (sum(n[c] for n in truth[0]) / len(truth[0]) for c in (2, 3))
    place = lambda n: ((n[2] - x0) * 111320.0 * math.cos(math.radians(y0)), (n[3] - y0) * 110540.0)

    def length(edges, a, b):
        near = {}
        for u, v, w in edges:
            near.setdefault(u, []).append((v, w))
            near.setdefault(v, []).append((u, w))
        done, queue = {}, [(0.0, a)]
        while queue:
            d, at = heapq.heappop(queue)
            if at not in done:
                done[at] = d
                for to, w in near.get(at, ()):
                    heapq.heappush(queue, (d + w, to))
        return done.get(b)

    def one_way(source, target):
        nodes = sorted(source[0], key=lambda n: (n[1], n[0]))
        if len(nodes) < 2:
            return 1.0
        rng, scores = random.Random(seed), []

        def nearest(n):
            d, to = min((math.dist(place(n), place(t)), t[0]) for t in target[0])
            return to if d < tolerance else None

        for _ in range(samples):
            a, b = rng.sample(nodes, 2)
            own = length(source[1], a[0], b[0])
            if own:
                a2, b2 = nearest(a), nearest(b)
                other = length(target[1], a2, b2) if a2 is not None and b2 is not None and a2 != b2 else None
                scores.append(0.0 if other is None else max(0.0, 1 - abs(own - other) / own))
        return sum(scores) / len(scores) if scores else 1.0

    return one_way(truth, proposal), one_way(proposal, truth)


@pytest.mark.parametrize("large", [False, True])
def test_apls_without_a_graph_of_all_points(spark, monkeypatch, large):
    """road_apls; as routing over the densified graphs gives it, odd orders, curves and lone nodes included."""
    import random

    from roadloom.graph import graph_of
    from roadloom.operators import paths, topology

    rng, sides = random.Random(12), ([], [])
    for g in range(9):
        n = rng.randint(2, 9)
        ids = rng.sample(range(-5, 60), n)
        at = {i: (73.82 + rng.random() * 0.002, 15.49 + rng.random() * 0.002) for i in ids}
        order = {i: rng.choice([i, rng.randint(0, 90)]) for i in ids}
        edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(rng.randint(1, 2 * n))}
        long = lambda u, v: ((at[u][0] - at[v][0]) ** 2 + (at[u][1] - at[v][1]) ** 2) ** 0.5 * 108000
        edges = [(f"g{g}", u, v, round(long(u, v) * rng.choice([0.8, 1.0, 1.0, 1.3]), g % 3)) for u, v in sorted(edges)]
        for side, share in zip(sides, (1.0, 0.7)):
            move = 0.0 if share == 1.0 else rng.choice([0.0, 0.00004])
            side.append(([(f"g{g}", i, order[i], at[i][0] + move, at[i][1]) for i in ids], [e for e in edges if rng.random() <= share]))
    graphs = [graph_of(spark.createDataFrame([r for nodes, _ in side for r in nodes], "graph_id string, node_id long, ord long, x double, y double"), spark.createDataFrame([r for _, edges in side for r in edges], "graph_id string, u long, v long, length_m double")) for side in sides]
    dense = [topology.densify(g, 20.0) for g in graphs]
    nodes = [d.nodes.select("graph_id", "node_id", "ord", "x", "y").collect() for d in dense]
    edges = [d.edges.select("graph_id", "u", "v", "length_m").collect() for d in dense]
    every = {f"g{g}": [([tuple(r[1:]) for r in n if r[0] == f"g{g}"], [tuple(r[1:]) for r in e if r[0] == f"g{g}"]) for n, e in zip(nodes, edges)] for g in range(9)}
    expected = {g: plain_apls(*both, samples=25, tolerance=15.0) for g, both in every.items()}
    monkeypatch.setattr(topology, "densify", None)
    if large:  # few rows a pack, few large blocks
        for name, value in (("PACK", 3), ("LARGE", 4), ("ROUTED", 20)):
            monkeypatch.setattr(paths, name, value)
    found = {r["graph_id"]: (r["truth_to_proposal"], r["proposal_to_truth"]) for r in paths.apls(*graphs, samples=25, interval=20.0).collect()}
    assert found.keys() == expected.keys() and len({x for v in expected.values() for x in v}) > 9
    for g in expected:
        assert found[g] == pytest.approx(expected[g], abs=1e-9), g


def test_few_distinct_lengths_travel_in_two_bytes():
    """lengths that are not whole but of few kinds."""
    import numpy as np

    from roadloom.operators import paths

    rng = np.random.default_rng(4)
    u = rng.integers(0, 2000, 30_000)
    v = u + rng.integers(1, 400, 30_000)
    w = rng.integers(1, 15_000, 30_000) * 1e-6
    data = paths._pack(u, v, w)
    nodes, a, b, (found,) = paths._unpack(data)
    assert sorted(zip(nodes[a].tolist(), nodes[b].tolist(), found.tolist())) == sorted(zip(u.tolist(), v.tolist(), w.tolist()))
    assert len(data) < 8 * len(u) + 8 * 15_000
    rest = rng.random(30_000)
    assert sorted(paths._unpack(paths._pack(u, v, rest))[3][0].tolist()) == sorted(rest.tolist())
    assert len(paths._unpack(paths._pack(u[:0], v[:0], w[:0]))[1]) == 0


def test_stubs_of_one_round_and_more(spark):
    """the first round needs degrees only."""
    from roadloom.operators import topology

    graph = drawn_graph(spark, 60, 62, seed=5)
    own = {(r["u"], r["v"]): r["length_m"] for r in graph.edges.collect()}
    for rounds in (0, 1, 2, 20):
        left = dict(own)
        for _ in range(rounds):
            degree = {}
            for e in left:
                for x in e:
                    degree[x] = degree.get(x, 0) + 1
            left = {e: w for e, w in left.items() if not (w < 6 and 1 in (degree[e[0]], degree[e[1]]))}
        assert {(r["u"], r["v"]) for r in topology.prune_stubs(graph, 6.0, rounds).edges.collect()} == set(left)
