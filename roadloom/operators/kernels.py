"""Operators that are sequential within one graph or one mask: a task holds one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geometry import douglas_peucker
from roadloom.graph import EDGES, RoadGraph
from roadloom.operators.topology import component_summary, components, consolidate, prune_stubs, with_degrees
from roadloom.storage import checkpoint


def _lines(column):
    return [[(p["x"], p["y"]) for p in line] for line in column]


def _points(line):
    return [{"x": x, "y": y} for x, y in line]


def collapse_degree2(graph: RoadGraph) -> RoadGraph:
    """Pass-through nodes become part of one edge, in node order; a node stays where that would make a loop or a parallel edge.

    The order matters only within a component of what takes part, so these are the unit of work.
    """
    # A collapse leaves all other degrees, so only nodes of degree 2 take part, with their edges and those between their neighbours; edges without a line get one here.
    through = checkpoint(with_degrees(graph).nodes.where("degree = 2").select("graph_id", "node_id"))
    at = lambda ids, end: ids.select("graph_id", F.col("node_id").alias(end))
    beside = graph.arcs().select("graph_id", F.col("src").alias("node_id"), "dst").join(through, ["graph_id", "node_id"], "left_semi")
    ends = checkpoint(through.unionByName(beside.select("graph_id", F.col("dst").alias("node_id"))).distinct().withColumn("hit", F.lit(True)))
    marked = graph.edges
    for end in ("u", "v"):
        marked = marked.join(ends.select("graph_id", F.col("node_id").alias(end), F.col("hit").alias(f"hit_{end}")), ["graph_id", end], "left")
    part = F.coalesce(F.col("hit_u") & F.col("hit_v"), F.lit(False)) | (F.size("geometry") < 2)
    edges = checkpoint(marked.where(part).select(graph.edges.columns))
    rest = marked.where(~part).select(graph.edges.columns)
    labels = components(edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")), edges)
    nodes = graph.nodes.select("graph_id", "node_id", "ord", "x", "y").join(labels, ["graph_id", "node_id"]).join(through.withColumn("through", F.lit(True)), ["graph_id", "node_id"], "left")
    edges = edges.join(labels.select("graph_id", F.col("node_id").alias("u"), "component"), ["graph_id", "u"])

    def run(key, left, right):
        import pandas as pd

        place = {n: (x, y) for n, x, y in zip(left["node_id"].tolist(), left["x"].tolist(), left["y"].tolist())}
        near: dict = {n: {} for n in place}
        for u, v, w, line, b in zip(right["u"].tolist(), right["v"].tolist(), right["length_m"].tolist(), _lines(right["geometry"]), right["is_bridged"].tolist()):
            near[u][v] = near[v][u] = (w, line, b)
        gap = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5

        def towards(line, a, b):
            """From a to b; a missing line is straight."""
            if len(line) < 2:
                return [place[a], place[b]]
            return line[::-1] if gap(line[0], place[a]) > gap(line[-1], place[a]) else line

        for node in left[left["through"].notna()].sort_values(["ord", "node_id"])["node_id"].tolist():
            (a, (wa, la, ba)), (c, (wc, lc, bc)) = near[node].items()
            if c in near[a]:
                continue
            line = towards(la, a, node) + towards(lc, node, c)[1:]
            for end in (a, c):
                del near[end][node]
            del near[node], place[node]
            near[a][c] = near[c][a] = (wa + wc, line, ba or bc)
        gone = set(left["node_id"].tolist()) - set(place)
        rows = [(key[0], n, None, None, None, None) for n in gone]
        rows += [(key[0], u, v, w, _points(towards(line, u, v)), bool(b)) for u in near for v, (w, line, b) in near[u].items() if u < v]
        return pd.DataFrame(rows, columns=["graph_id", "u", "v", "length_m", "geometry", "is_bridged"]).astype({"v": "Int64"})

    out = nodes.groupBy("graph_id", "component").cogroup(edges.select(*[F.col(c).alias(c) for c in [*graph.edges.columns, "component"]]).groupBy("graph_id", "component")).applyInPandas(run, EDGES)
    out = checkpoint(out)
    gone = out.where("v is null").select("graph_id", F.col("u").alias("node_id"))
    return RoadGraph(graph.nodes.join(gone, ["graph_id", "node_id"], "left_anti"), rest.unionByName(out.where("v is not null")))


def simplify(graph: RoadGraph, min_stub: float = 15.0) -> tuple[RoadGraph, DataFrame]:
    """Stubs pruned, then pass-through nodes collapsed; and a report by graph. The components may not become more."""
    pruned = prune_stubs(graph, min_stub)
    done = collapse_degree2(pruned)
    counts = [g.nodes.groupBy("graph_id").agg(F.count("*").alias(n)) for g, n in ((graph, "nodes_before"), (pruned, "nodes_pruned"), (done, "nodes_after"))]
    parts = [component_summary(components(g.nodes, g.edges)).select("graph_id", F.col("n_components").alias(n)) for g, n in ((graph, "components_before"), (done, "components_after"))]
    report = counts[0]
    for other in (*counts[1:], *parts):
        report = report.join(other, "graph_id", "left")
    report = report.fillna(0).withColumn("stubs_removed", F.col("nodes_before") - F.col("nodes_pruned")).withColumn("nodes_collapsed", F.col("nodes_pruned") - F.col("nodes_after"))
    report = report.withColumn("node_reduction_pct", F.when(F.col("nodes_before") > 0, 100.0 * (F.col("nodes_before") - F.col("nodes_after")) / F.col("nodes_before")).otherwise(0.0))
    report = report.withColumn("split", F.when(F.col("components_after") > F.col("components_before"), F.raise_error(F.lit("simplification split a component"))).otherwise(F.lit(False)))
    return with_degrees(done), report


def consolidated(graph: RoadGraph, tolerance: float = 10.0) -> tuple[RoadGraph, DataFrame]:
    """Near junctions merged and chains collapsed again; and a report by graph."""
    merged = consolidate(graph, tolerance)
    merged = RoadGraph(checkpoint(merged.nodes), checkpoint(merged.edges))
    done = collapse_degree2(merged)
    counts = [g.nodes.groupBy("graph_id").agg(F.count("*").alias(n)) for g, n in ((graph, "nodes_before"), (merged, "nodes_merged"), (done, "nodes_after"))]
    report = counts[0].join(counts[1], "graph_id", "left").join(counts[2], "graph_id", "left").fillna(0)
    return with_degrees(done), report.withColumn("merged", F.col("nodes_before") - F.col("nodes_merged"))


def _two_forests(edges):
    """A breadth-first forest of the edges (pairs) and a forest of the rest: at most 2 (n - 1) edges with the same cut nodes and bridges.

    Whatever edges are added to both, so pieces of a graph may be thinned apart (Eppstein, Galil, Italiano, Nissenzweig 1997).
    """
    near: dict = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    first, above = set(), {}
    for root in near:
        if root in above:
            continue
        above[root], level = root, [root]
        while level:
            below = []
            for a in level:
                for b in near[a]:
                    if b not in above:
                        above[b] = a
                        first.add((a, b) if a < b else (b, a))
                        below.append(b)
            level = below
    parent = {x: x for x in near}
    kept = list(first)
    for u, v in edges:
        a, b = u, v
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b and ((u, v) if u < v else (v, u)) not in first:
            parent[a] = b
            kept.append((u, v))
    return kept


def thinned(edges: DataFrame, room: int = 400_000) -> DataFrame:
    """``edges(graph_id, u, v)``, each task's reduced to two forests a graph: the same cut nodes and bridges.

    A task holds ``room`` new edges besides its forests; forests beyond that room are passed on.
    """

    def run(batches):
        import pandas as pd

        held: dict = {}
        fresh = 0

        def frame():
            rows = [(g, u, v) for g, pairs in held.items() for u, v in pairs]
            return pd.DataFrame(rows, columns=["graph_id", "u", "v"]).astype({"graph_id": "object", "u": "int64", "v": "int64"})

        def thin_held():
            for g in held:
                held[g] = _two_forests(held[g])

        for batch in batches:
            for g, part in batch.groupby("graph_id", sort=False):
                held.setdefault(g, []).extend(zip(part["u"].tolist(), part["v"].tolist()))
            fresh += len(batch)
            if fresh > room:
                thin_held()
                fresh = 0
                if sum(map(len, held.values())) > room:
                    yield frame()
                    held.clear()
        thin_held()
        yield frame()

    return edges.select("graph_id", "u", "v").mapInPandas(run, "graph_id string, u long, v long")


def cut_structure(graph: RoadGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes with is_articulation and edges with is_bridge, by low-links, a component a task, after thinning in rounds."""
    slim = checkpoint(thinned(graph.edges))
    parts = slim.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 8)
        slim = checkpoint(thinned(slim.repartition(parts)))
    labels = components(graph.nodes, slim)
    edges = slim.join(labels.select("graph_id", F.col("node_id").alias("u"), "component"), ["graph_id", "u"])

    def run(key, pdf):
        import pandas as pd

        near: dict = {}
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        seen, low, cut, bridges = {}, {}, set(), []
        for root in near:
            if root in seen:
                continue
            seen[root] = low[root] = len(seen)
            stack, children = [(root, None, iter(near[root]))], 0
            while stack:
                at, parent, rest = stack[-1]
                for to in rest:
                    if to == parent:
                        continue
                    if to in seen:
                        low[at] = min(low[at], seen[to])
                    else:
                        seen[to] = low[to] = len(seen)
                        stack.append((to, at, iter(near[to])))
                        break
                else:
                    stack.pop()
                    if parent is None:
                        continue
                    low[parent] = min(low[parent], low[at])
                    if low[at] > seen[parent]:
                        bridges.append((min(at, parent), max(at, parent)))
                    if parent == root:
                        children += 1
                    elif low[at] >= seen[parent]:
                        cut.add(parent)
            if children > 1:
                cut.add(root)
        rows = [(key[0], n, None) for n in cut] + [(key[0], u, v) for u, v in bridges]
        return pd.DataFrame(rows, columns=["graph_id", "u", "v"]).astype({"v": "Int64"})

    found = checkpoint(edges.groupBy("graph_id", "component").applyInPandas(run, "graph_id string, u long, v long"))
    cut = found.where("v is null").select("graph_id", F.col("u").alias("node_id"), F.lit(True).alias("hit"))
    nodes = graph.nodes.join(cut, ["graph_id", "node_id"], "left").withColumn("is_articulation", F.coalesce("hit", F.lit(False))).drop("hit")
    bridges = found.where("v is not null").withColumn("hit", F.lit(True))
    edges = graph.edges.join(bridges, ["graph_id", "u", "v"], "left").withColumn("is_bridge", F.coalesce("hit", F.lit(False))).drop("hit")
    return nodes, edges


def simplify_lines(edges: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Edges with Douglas-Peucker geometry and the vertex counts before and after; lengths stay, as do lines of two points."""

    def run(batches):
        for batch in batches:
            kept = [line if len(line) <= 2 else douglas_peucker(line, tolerance) for line in _lines(batch["geometry"])]
            counts = [len(x) for x in batch["geometry"]], [len(x) for x in kept]
            yield batch.assign(geometry=[_points(x) for x in kept], vertices_before=counts[0], vertices_after=counts[1])

    schema = ", ".join(f"{n} {t}" for n, t in edges.dtypes)
    return edges.mapInPandas(run, schema + ", vertices_before int, vertices_after int")


def thin(mask):
    """Zhang-Suen thinning of a 2-D 0/1 array."""
    import numpy as np

    if mask.ndim != 2:
        raise ValueError("a mask has two dimensions")
    img = np.pad(mask.astype(bool), 1)
    while True:
        changed = False
        for first in (True, False):
            p = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # N, NE, E, SE, S, SW, W, NW
            total = sum(x.astype(np.int8) for x in p)
            rises = sum((~a & b).astype(np.int8) for a, b in zip(p, p[1:] + p[:1]))
            n, _, e, _, s, _, w, _ = p
            sides = ~(n & e & s) & ~(e & s & w) if first else ~(n & e & w) & ~(n & s & w)
            drop = img & (total >= 2) & (total <= 6) & (rises == 1) & sides
            if drop.any():
                img, changed = img & ~drop, True
        if not changed:
            return img[1:-1, 1:-1].astype(np.uint8)


def _grid(pdf):
    import numpy as np

    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    grid = np.zeros((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.uint8)
    grid[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = 1
    return grid, r0, c0


def skeletons(pixels: DataFrame) -> DataFrame:
    """``pixels(mask_id, row, col)`` thinned to lines one pixel wide."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        grid, r0, c0 = _grid(pdf)
        rows, cols = np.nonzero(thin(grid))
        return pd.DataFrame({"mask_id": pdf["mask_id"].iloc[0], "row": rows + r0, "col": cols + c0})

    return pixels.groupBy("mask_id").applyInPandas(run, "mask_id string, row int, col int")


def skeleton_chains(pixels: set):
    """Node clusters and the pixel chains between them of an 8-connected skeleton: (clusters, [(a, b, chain)])."""
    around = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
    near = lambda p: [q for q in ((p[0] + a, p[1] + b) for a, b in around) if q in pixels]
    special = {p for p in pixels if len(near(p)) != 2}
    label: dict = {}
    clusters: list = []

    def cluster(seed):
        stack, own = [seed], []
        label[seed] = len(clusters)
        while stack:
            p = stack.pop()
            own.append(p)
            for q in near(p):
                if q in special and q not in label:
                    label[q] = len(clusters)
                    stack.append(q)
        clusters.append(sorted(own))

    for p in sorted(special):
        if p not in label:
            cluster(p)
    used, chains = set(), []

    def follow(start, at):
        path, back = [start, at], start
        while at not in label:
            used.add(at)
            ahead = [q for q in near(at) if q != back and q not in used]
            ends = [q for q in ahead if q in label and (label[q] != label[start] or len(path) > 3)]
            nxt = (ends or [q for q in ahead if q not in label] or [q for q in ahead if q in label] or [None])[0]
            if nxt is None:
                return None
            back, at = at, nxt
            path.append(at)
        return path

    for p in sorted(special):
        for q in near(p):
            if q not in label and q not in used and (path := follow(p, q)):
                chains.append((label[path[0]], label[path[-1]], path))
    for p in sorted(pixels - used - special):  # rings without a junction
        if p in used or p in label:
            continue
        special.add(p)
        label[p] = len(clusters)
        clusters.append([p])
        for q in near(p):
            if q not in label and q not in used and (path := follow(p, q)):
                chains.append((label[p], label[path[-1]], path))
    return clusters, chains


def skeleton_graph(pixels: DataFrame, resolution: float = 1.0, transform: tuple | None = None) -> RoadGraph:
    """The metric graph of skeleton ``pixels(mask_id, row, col)``, a graph a mask; nodes are the centroids of junction and end pixels."""

    def run(pdf):
        import pandas as pd

        name = pdf["mask_id"].iloc[0]
        clusters, chains = skeleton_chains(set(zip(pdf["row"].tolist(), pdf["col"].tolist())))

        def world(row, col):
            if transform is None:
                return {"x": col * resolution, "y": row * resolution}
            a, b, c, d, e, f = transform
            return {"x": a * (col + 0.5) + b * (row + 0.5) + c, "y": d * (col + 0.5) + e * (row + 0.5) + f}

        centres = [world(sum(p[0] for p in c) / len(c), sum(p[1] for p in c) / len(c)) for c in clusters]
        rows = [(name, i, None, None, [p]) for i, p in enumerate(centres)]
        for a, b, path in chains:
            if a != b:
                line = [centres[a], *(world(*p) for p in path[1:-1]), centres[b]]
                length = sum(((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2) ** 0.5 for p, q in zip(line, line[1:]))
                rows.append((name, min(a, b), max(a, b), length, line if a < b else line[::-1]))
        return pd.DataFrame(rows, columns=["graph_id", "u", "v", "length_m", "geometry"]).astype({"v": "Int64"})

    found = checkpoint(pixels.groupBy("mask_id").applyInPandas(run, "graph_id string, u long, v long, length_m double, geometry array<struct<x:double,y:double>>"))
    nodes = found.where("v is null").select("graph_id", F.col("u").alias("node_id"), F.col("u").alias("ord"), F.col("geometry")[0]["x"].alias("x"), F.col("geometry")[0]["y"].alias("y"))
    edges = found.where("v is not null").withColumn("is_bridged", F.lit(False))
    best = edges.groupBy("graph_id", "u", "v").agg(F.min_by(F.struct("length_m", "geometry", "is_bridged"), "length_m").alias("e")).select("graph_id", "u", "v", "e.*")
    return RoadGraph(nodes, best)
