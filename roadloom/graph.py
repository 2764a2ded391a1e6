"""The road graph: node and edge tables keyed by graph, their schemas and their contract."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
NODES = "graph_id string, node_id long, ord long, x double, y double"
EDGES = f"graph_id string, u long, v long, length_m double, geometry array<{POINT}>, is_bridged boolean"


@dataclass(frozen=True)
class RoadGraph:
    """An undirected simple graph for each ``graph_id``; edges are unique with u < v.

    ``ord`` is the insertion order of a node: ties are broken by it.
    """

    nodes: DataFrame
    edges: DataFrame

    def with_nodes(self, nodes: DataFrame) -> RoadGraph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> RoadGraph:
        return replace(self, edges=edges)

    def arcs(self) -> DataFrame:
        """Both directions of every edge: graph_id, src, dst, and the edge's other columns."""
        rest = [c for c in self.edges.columns if c not in ("graph_id", "u", "v")]
        one = self.edges.select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst"), *rest)
        two = self.edges.select("graph_id", F.col("v").alias("src"), F.col("u").alias("dst"), *rest)
        return one.unionByName(two)


def graph_of(nodes: DataFrame, edges: DataFrame) -> RoadGraph:
    """A graph from loose tables: nodes(node_id[, graph_id, ord, x, y]), edges(u, v[, graph_id, length_m, geometry, is_bridged]).

    Missing columns get defaults: one graph, order by id, origin, chord length,
    straight geometry, observed. Ends are ordered; self-loops go; of parallel edges
    the shortest stays.
    """
    fill = {"graph_id": F.lit("g"), "ord": F.col("node_id"), "x": F.lit(0.0), "y": F.lit(0.0)}
    for c, value in fill.items():
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, value)
    nodes = nodes.select("graph_id", F.col("node_id").cast("long").alias("node_id"), F.col("ord").cast("long").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[c for c in nodes.columns if c not in ("graph_id", "node_id", "ord", "x", "y")])
    if "graph_id" not in edges.columns:
        edges = edges.withColumn("graph_id", F.lit("g"))
    if "is_bridged" not in edges.columns:
        edges = edges.withColumn("is_bridged", F.lit(False))
    if "geometry" not in edges.columns or "length_m" not in edges.columns:
        at = lambda end: nodes.select("graph_id", F.col("node_id").alias(end), F.struct("x", "y").alias(f"p{end}"))
        edges = edges.join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"])
        if "geometry" not in edges.columns:
            edges = edges.withColumn("geometry", F.array("pu", "pv"))
        if "length_m" not in edges.columns:
            dx, dy = F.col("pu.x") - F.col("pv.x"), F.col("pu.y") - F.col("pv.y")
            edges = edges.withColumn("length_m", F.sqrt(dx * dx + dy * dy))
    turned = F.when(F.col("u") > F.col("v"), F.reverse("geometry")).otherwise(F.col("geometry"))
    edges = edges.where("u <> v").select(
        "graph_id", F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), F.col("length_m").cast("double").alias("length_m"), turned.alias("geometry"), "is_bridged"
    )
    return RoadGraph(nodes, shortest_parallel(edges))


def shortest_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each pair of ends: the shortest."""
    rest = F.struct("length_m", "geometry", "is_bridged")
    best = edges.groupBy("graph_id", "u", "v").agg(F.min_by(rest, F.col("length_m")).alias("e"))
    return best.select("graph_id", "u", "v", "e.*")


def violations(graph: RoadGraph) -> DataFrame:
    """(graph_id, rule, n): breaches of the contract; no rows if it holds."""
    ids = graph.nodes.select("graph_id", F.col("node_id"))
    ends = graph.edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id"))
    checks = {
        "duplicate node": ids.groupBy("graph_id", "node_id").count().where("count > 1").select("graph_id"),
        "dangling edge": ends.join(ids, ["graph_id", "node_id"], "left_anti").select("graph_id"),
        "self-loop": graph.edges.where("u = v").select("graph_id"),
        "unordered ends": graph.edges.where("u > v").select("graph_id"),
        "duplicate edge": graph.edges.groupBy("graph_id", "u", "v").count().where("count > 1").select("graph_id"),
        "length not positive": graph.edges.where("not coalesce(length_m > 0, false)").select("graph_id"),
    }
    found = None
    for rule, rows in checks.items():
        rows = rows.groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", F.lit(rule).alias("rule"), "n")
        found = rows if found is None else found.unionByName(rows)
    return found
