"""Topology of road graphs as joins, aggregates and fixpoints: degrees, components, pruning, merging, healing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geometry import bezier_bridge, outward_heading, polyline_length, turn_angle
from roadloom.graph import RoadGraph, shortest_parallel
from roadloom.storage import checkpoint


#: So many nodes are few beside a graph's edges.
FEW = 100_000


def node_type(degree: Column) -> Column:
    """Dead ends are endpoints, everything else (isolated nodes too) intersections."""
    return F.when(degree == 1, "endpoint").otherwise("intersection")


def with_degrees(graph: RoadGraph) -> RoadGraph:
    """Degree and type of every node."""
    degrees = graph.edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
    nodes = graph.nodes.drop("degree", "type").join(degrees, ["graph_id", "node_id"], "left")
    nodes = nodes.withColumn("degree", F.coalesce("degree", F.lit(0)).cast("int")).withColumn("type", node_type(F.col("degree")))
    return graph.with_nodes(nodes)


def without_nodes(graph: RoadGraph, removed: DataFrame) -> RoadGraph:
    """The graph without ``removed(graph_id, node_id)`` and the edges that touch them."""
    ids = removed.select("graph_id", "node_id").distinct()
    edges = graph.edges
    for end in ("u", "v"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    return RoadGraph(graph.nodes.join(ids, ["graph_id", "node_id"], "left_anti"), edges.select(graph.edges.columns))


def without_isolated(graph: RoadGraph) -> RoadGraph:
    ends = graph.edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return graph.with_nodes(graph.nodes.join(ends, ["graph_id", "node_id"], "left_semi"))


def _local_forest(batches):
    """Spanning stars of the links that one task holds, by graph: (graph_id, node, smallest node of its local component)."""
    import pandas as pd

    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars():
        rows = [(g, n, find((g, n))[1]) for g, n in list(parent)]
        return pd.DataFrame([r for r in rows if r[1] != r[2]], columns=["graph_id", "a", "b"]).astype({"graph_id": "object", "a": "int64", "b": "int64"})

    for batch in batches:
        for g, a, b in zip(batch["graph_id"], batch["a"].tolist(), batch["b"].tolist()):
            ra, rb = find((g, a)), find((g, b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 500_000:  # bounded memory: pass on what is known and start anew
            yield stars()
            parent.clear()
    yield stars()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, node_id, component): component is the smallest node id reachable over ``links(graph_id, u, v)``.

    Tasks contract the links they hold; then large-star and small-star rounds
    (Kiveris et al. 2014) until every node points at its component's smallest.
    """
    key = ["graph_id", "a"]
    pairs = links.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b")
    pairs = checkpoint(pairs.mapInPandas(_local_forest, "graph_id string, a long, b long").distinct())
    while True:
        both = pairs.unionByName(pairs.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(key).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, key).select("graph_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(key).agg(F.min("b").alias("m"))
        small = large.join(least, key).select("graph_id", F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        pairs = checkpoint(small.where("a <> b").distinct())
        sources = pairs.groupBy(key).agg(F.count("*").alias("n"))
        targets = pairs.select("graph_id", F.col("b").alias("a"), F.lit(-1).cast("long").alias("n")).distinct()
        # At rest each node has one link, and no target has one of its own.
        if not sources.unionByName(targets).groupBy(key).agg(F.max("n").alias("most"), F.min("n").alias("least")).where("most > 1 or (least < 0 and most > 0)").limit(1).count():
            break
    found = pairs.select("graph_id", F.col("a").alias("node_id"), F.col("b").alias("component"))
    return nodes.select("graph_id", "node_id").distinct().join(found, ["graph_id", "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))


def component_summary(labels: DataFrame) -> DataFrame:
    """(graph_id, n_components, largest, n_nodes)."""
    sizes = labels.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("graph_id").agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), F.sum("n").alias("n_nodes"))


def prune_degenerate(graph: RoadGraph, min_length: float = 0.5) -> RoadGraph:
    """Without self-loops and edges below ``min_length``, and without the nodes they leave alone."""
    kept = graph.edges.where((F.col("u") != F.col("v")) & (F.col("length_m") >= min_length))
    touched = lambda e: e.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    orphans = touched(graph.edges).join(touched(kept), ["graph_id", "node_id"], "left_anti")
    return RoadGraph(graph.nodes.join(orphans, ["graph_id", "node_id"], "left_anti"), kept)


def prune_stubs(graph: RoadGraph, min_stub: float = 15.0, rounds: int = 20) -> RoadGraph:
    """All short leaves at once, round by round, at most ``rounds`` times."""
    # Only degrees and short edges change from round to round; the graph itself is cut once, at the end.
    near = graph.arcs().groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"), F.min("dst").alias("to"), F.min("length_m").alias("length_m"))
    degrees = checkpoint(graph.nodes.select("graph_id", "node_id").join(near, ["graph_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("int")))
    # A leaf has one edge, so the first round needs no others.
    first = checkpoint(degrees.where((F.col("degree") == 1) & (F.col("length_m") < min_stub)).select("graph_id", "node_id", "to"))
    short = removed = None
    for turn in range(rounds):
        if turn == 1:
            away = first.select("graph_id", "node_id")
            short = graph.arcs().where(F.col("length_m") < min_stub).select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("to"))
            short = checkpoint(short.join(away, ["graph_id", "node_id"], "left_anti").join(away.withColumnRenamed("node_id", "to"), ["graph_id", "to"], "left_anti").select("graph_id", "node_id", "to"))
        leaves = degrees.where("degree = 1").select("graph_id", "node_id")
        hit = checkpoint(short.join(leaves, ["graph_id", "node_id"], "left_semi")) if turn else first
        if not hit.limit(1).count():
            break
        gone = hit.select("graph_id", "node_id").distinct()
        removed = gone if removed is None else removed.unionByName(gone)
        lost = hit.groupBy("graph_id", F.col("to").alias("node_id")).agg(F.count("*").alias("lost"))
        degrees = degrees.join(gone, ["graph_id", "node_id"], "left_anti").join(lost, ["graph_id", "node_id"], "left")
        degrees = checkpoint(degrees.select("graph_id", "node_id", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree")))
        if turn:
            short = short.join(gone, ["graph_id", "node_id"], "left_anti").join(gone.withColumnRenamed("node_id", "to"), ["graph_id", "to"], "left_anti")
            short = checkpoint(short.select("graph_id", "node_id", "to"))
    if removed is None:
        return graph
    removed = checkpoint(removed)
    # A few nodes go to the edges, rather than the edges to them.
    return without_nodes(graph, F.broadcast(removed) if removed.count() <= FEW else removed)


def consolidate(graph: RoadGraph, tolerance: float) -> RoadGraph:
    """Clusters joined by edges shorter than ``tolerance`` become their smallest node at the cluster's centroid.

    Nearness without an edge never merges. Of edges made parallel the shorter stays;
    geometry is not moved.
    """
    labels = components(graph.nodes, graph.edges.where(F.col("length_m") < tolerance))
    nodes = graph.nodes.join(labels, ["graph_id", "node_id"])
    centre = nodes.groupBy("graph_id", "component").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    nodes = nodes.where("node_id = component").join(centre, ["graph_id", "component"])
    nodes = nodes.withColumn("x", F.col("cx")).withColumn("y", F.col("cy")).select(graph.nodes.columns)
    edges = graph.edges
    for end in ("u", "v"):
        edges = edges.join(labels.select("graph_id", F.col("node_id").alias(end), F.col("component").alias(f"{end}_to")), ["graph_id", end])
    turned = F.when(F.col("u_to") > F.col("v_to"), F.reverse("geometry")).otherwise(F.col("geometry"))
    edges = edges.where("u_to <> v_to").select("graph_id", F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v"), "length_m", turned.alias("geometry"), "is_bridged")
    return RoadGraph(nodes, shortest_parallel(edges))


def near_pairs(points: DataFrame, reach: float, places: bool = False) -> DataFrame:
    """(graph_id, u, v, distance_m) for all pairs u < v of ``points(graph_id, node_id, x, y)`` within ``reach``, inclusive; with ``places`` their ux, uy, vx, vy too.

    Points meet in grid cells as wide as the reach: an equi-join of each point's own
    cell with the nine around it, so work follows the number of near pairs.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    own = points.select("graph_id", F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), cell("x").alias("i"), cell("y").alias("j"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = points.select("graph_id", F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), cell("x").alias("ci"), cell("y").alias("cj"), F.explode(steps).alias("s"))
    spread = spread.select("graph_id", "v", "vx", "vy", (F.col("ci") + F.col("s.a")).alias("i"), (F.col("cj") + F.col("s.b")).alias("j"))
    dx, dy = F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")
    pairs = own.join(spread, ["graph_id", "i", "j"]).where("u < v").withColumn("distance_m", F.sqrt(dx * dx + dy * dy))
    return pairs.where(F.col("distance_m") <= reach).select("graph_id", "u", "v", "distance_m", *(("ux", "uy", "vx", "vy") if places else ()))


def nearest_within(sources: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """``sources(graph_id, node_id, x, y)`` with the nearest target's id (ties: smallest) and distance, null beyond ``reach`` (exclusive)."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    near = targets.select("graph_id", F.col("node_id").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("ci"), cell("y").alias("cj"), F.explode(steps).alias("s"))
    near = near.select("graph_id", "to", "tx", "ty", (F.col("ci") + F.col("s.a")).alias("i"), (F.col("cj") + F.col("s.b")).alias("j"))
    own = sources.withColumn("i", cell("x")).withColumn("j", cell("y"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    found = own.join(near, ["graph_id", "i", "j"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") < reach)
    best = found.groupBy("graph_id", "node_id").agg(F.min(F.struct("d", "to")).alias("b")).select("graph_id", "node_id", F.col("b.to").alias("nearest"), F.col("b.d").alias("distance_m"))
    return sources.join(best, ["graph_id", "node_id"], "left")


def bridge_candidates(graph: RoadGraph, gap: float = 40.0, max_angle: float = 60.0, angle_penalty: float = 2.0) -> DataFrame:
    """Pairs of dead ends of different components, near enough and turning little enough at both ends; lower scores are better."""
    labels = components(graph.nodes, graph.edges)
    nodes = with_degrees(graph).nodes
    ends = nodes.where("degree = 1").join(labels, ["graph_id", "node_id"])
    lines = graph.arcs().select("graph_id", F.col("src").alias("node_id"), "geometry")
    ends = ends.join(lines, ["graph_id", "node_id"]).select("graph_id", "node_id", "x", "y", "component", outward_heading(F.col("geometry"), F.struct("x", "y")).alias("heading"))
    ends = checkpoint(ends)
    pairs = near_pairs(ends, gap)
    for end in ("u", "v"):
        side = ends.select("graph_id", F.col("node_id").alias(end), F.struct("x", "y").alias(f"p{end}"), F.col("component").alias(f"c{end}"), F.col("heading").alias(f"dir_{end}"))
        pairs = pairs.join(side, ["graph_id", end])
    dx, dy = F.col("pv.x") - F.col("pu.x"), F.col("pv.y") - F.col("pu.y")
    angle = F.greatest(turn_angle(F.col("dir_u"), dx, dy), turn_angle(F.col("dir_v"), -dx, -dy))
    pairs = pairs.where("cu <> cv").withColumn("angle_deg", angle).where(F.col("angle_deg") <= max_angle)
    score = F.col("distance_m") * (1 + angle_penalty * F.col("angle_deg") / 180)
    return pairs.select("graph_id", "u", "v", "distance_m", "angle_deg", score.alias("score"), "dir_u", "dir_v", "pu", "pv", "cu", "cv")


def minimum_forest(candidates: DataFrame) -> DataFrame:
    """The rows of ``candidates(graph_id, u, v, cu, cv, score, ...)`` in a minimum spanning forest over components.

    Boruvka rounds: each component takes its best edge by (score, u, v), a strict
    order, so the forest is the one that taking edges in order gives.
    """
    open_edges = checkpoint(candidates)
    chosen = None
    while open_edges.limit(1).count():
        rank = F.struct("score", "u", "v")
        sides = open_edges.select("graph_id", F.explode(F.array("cu", "cv")).alias("c"), "u", "v", "score")
        best = sides.groupBy("graph_id", "c").agg(F.min(rank).alias("b")).select("graph_id", "b.u", "b.v").distinct()
        best = checkpoint(open_edges.join(best, ["graph_id", "u", "v"], "left_semi"))
        taken = best.select("graph_id", "u", "v")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        links = best.select("graph_id", F.col("cu").alias("u"), F.col("cv").alias("v"))
        parts = links.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
        labels = components(parts, links)
        for side in ("cu", "cv"):
            open_edges = open_edges.join(labels.select("graph_id", F.col("node_id").alias(side), F.col("component").alias("to")), ["graph_id", side], "left")
            open_edges = open_edges.withColumn(side, F.coalesce("to", side)).drop("to")
        open_edges = checkpoint(open_edges.where("cu <> cv").select(candidates.columns))
    if chosen is None:
        return candidates.limit(0)
    return candidates.join(chosen, ["graph_id", "u", "v"], "left_semi")


def heal(graph: RoadGraph, gap: float = 40.0, max_angle: float = 60.0, angle_penalty: float = 2.0) -> tuple[RoadGraph, DataFrame]:
    """The graph with curved bridges over its gaps, and a report by graph."""
    bridges = minimum_forest(bridge_candidates(graph, gap, max_angle, angle_penalty))
    line = bezier_bridge(F.col("pu"), F.col("pv"), F.col("dir_u"), F.col("dir_v"))
    new = bridges.select("graph_id", "u", "v", line.alias("geometry"), F.lit(True).alias("is_bridged"))
    new = checkpoint(new.withColumn("length_m", F.greatest(polyline_length(F.col("geometry")), F.lit(1e-6))).select(graph.edges.columns))
    healed = graph.with_edges(graph.edges.unionByName(new))
    before = component_summary(components(graph.nodes, graph.edges)).select("graph_id", F.col("n_components").alias("components_before"), F.col("largest").alias("largest_before"))
    after = component_summary(components(healed.nodes, healed.edges)).select("graph_id", F.col("n_components").alias("components_after"), F.col("largest").alias("largest_after"))
    added = new.groupBy("graph_id").agg(F.count("*").alias("n"))
    report = before.join(after, "graph_id").join(added, "graph_id", "left").select(
        "graph_id", F.coalesce("n", F.lit(0)).alias("bridges_added"), "components_before", "components_after", "largest_before", "largest_after",
        F.when(F.col("largest_before") > 0, 100.0 * (F.col("largest_after") - F.col("largest_before")) / F.col("largest_before")).otherwise(0.0).alias("connectivity_gain_pct"),
    )
    marked = with_degrees(healed)
    ends = new.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct().withColumn("hit", F.lit(True))
    nodes = marked.nodes.join(ends, ["graph_id", "node_id"], "left").withColumn("type", F.when(F.col("hit"), "bridged").otherwise(F.col("type"))).drop("hit")
    return marked.with_nodes(nodes), report


def densify(graph: RoadGraph, interval: float) -> RoadGraph:
    """Edges cut along the chord into max(1, round(length / interval)) equal parts; new nodes follow the old ids in edge order."""
    ends = graph.nodes.select("graph_id", "node_id", F.struct("x", "y").alias("p"))
    edges = graph.edges.join(ends.select("graph_id", F.col("node_id").alias("u"), F.col("p").alias("pu")), ["graph_id", "u"]).join(ends.select("graph_id", F.col("node_id").alias("v"), F.col("p").alias("pv")), ["graph_id", "v"])
    edges = edges.withColumn("k", F.greatest(F.lit(1), F.bround(F.col("length_m") / interval)).cast("int"))
    top = graph.nodes.groupBy("graph_id").agg(F.max("node_id").alias("top"))
    order = Window.partitionBy("graph_id").orderBy("u", "v").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.join(top, "graph_id").withColumn("first", F.col("top") + 1 + F.coalesce(F.sum(F.col("k") - 1).over(order), F.lit(0)))
    edges = checkpoint(edges.select("graph_id", "u", "v", "length_m", "pu", "pv", "k", "first", "is_bridged"))
    at = lambda c: F.col(f"pu.{c}") + (F.col(f"pv.{c}") - F.col(f"pu.{c}")) * F.col("i") / F.col("k")
    inner = edges.where("k > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    inner = inner.select("graph_id", (F.col("first") + F.col("i") - 1).alias("node_id"), (F.col("first") + F.col("i") - 1).alias("ord"), at("x").alias("x"), at("y").alias("y"))
    nodes = graph.nodes.select("graph_id", "node_id", "ord", "x", "y").unionByName(inner)
    part = edges.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    a = F.when(F.col("i") == 0, F.col("u")).otherwise(F.col("first") + F.col("i") - 1)
    b = F.when(F.col("i") == F.col("k") - 1, F.col("v")).otherwise(F.col("first") + F.col("i"))
    point = lambda j: F.struct(*((F.col(f"pu.{c}") + (F.col(f"pv.{c}") - F.col(f"pu.{c}")) * j / F.col("k")).alias(c) for c in ("x", "y")))
    parts = part.select("graph_id", F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (F.col("length_m") / F.col("k")).alias("length_m"), F.array(point(F.col("i")), point(F.col("i") + 1)).alias("geometry"), "is_bridged")
    return RoadGraph(nodes, parts)

