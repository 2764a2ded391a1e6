"""Readers and writers of graph, table and mask files."""

from __future__ import annotations

import json
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.graph import RoadGraph, graph_of
from roadloom.operators.splits import truthy

FEATURES = (
    "features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:struct<feature_type:string,node_id:long,degree:int,type:string,"
    "betweenness:double,is_critical:string,is_articulation:string,status:string,u:long,v:long,length_m:double,is_bridged:string,is_bridge:string,edge_betweenness:double>>>, meta string"
)
CRITICALITY = "node_id long, betweenness double, rank int, is_critical boolean, is_articulation boolean, x double, y double"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of a GeoJSON collection: one wide row each, geometry as JSON text."""
    whole = spark.read.schema(FEATURES).json(path, multiLine=True)
    rows = whole.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("coordinates"))
    for flag in ("is_critical", "is_articulation", "is_bridged", "is_bridge"):
        rows = rows.withColumn(flag, truthy(F.col(flag)))
    return rows


def split_features(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a feature table; an error where an id is missing."""
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a feature lacks {c}")).cast("long"))
    nodes = rows.where("feature_type = 'node'").withColumn("node_id", need("node_id"))
    edges = rows.where("feature_type = 'edge'").withColumn("u", need("u")).withColumn("v", need("v"))
    return nodes, edges


def graph_from_features(rows: DataFrame, graph_id: str = "g") -> RoadGraph:
    nodes, edges = split_features(rows)
    at = F.from_json("coordinates", "array<double>")
    nodes = nodes.select(F.lit(graph_id).alias("graph_id"), "node_id", at[0].alias("x"), at[1].alias("y"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), "is_critical", "is_articulation")
    line = F.transform(F.from_json("coordinates", "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    edges = edges.select(F.lit(graph_id).alias("graph_id"), "u", "v", F.coalesce("length_m", F.lit(0.0)).alias("length_m"), line.alias("geometry"), "is_bridged")
    return graph_of(nodes, edges)


def feature_rows(graph: RoadGraph) -> DataFrame:
    """(graph_id, feature): the JSON text of every node and edge; 6 decimals for places, 3 for lengths; a missing line is straight."""
    have = lambda df, c, default: F.col(c) if c in df.columns else default
    n, e = graph.nodes, graph.edges
    nodes = n.select("graph_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.round("x", 6), F.round("y", 6)).alias("coordinates")).alias("geometry"), F.struct(
        F.lit("node").alias("feature_type"), "node_id", have(n, "degree", F.lit(0)).alias("degree"), have(n, "type", F.lit("intersection")).alias("type"), F.round(have(n, "betweenness", F.lit(0.0)), 6).alias("betweenness"),
        have(n, "is_critical", F.lit(False)).alias("is_critical"), have(n, "is_articulation", F.lit(False)).alias("is_articulation")).alias("properties"))).alias("feature"))
    at = lambda end: n.select("graph_id", F.col("node_id").alias(end), F.struct("x", "y").alias(f"p{end}"))
    both = e.join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"])
    line = F.when(F.size("geometry") >= 2, F.col("geometry")).otherwise(F.array("pu", "pv"))
    line = F.transform(line, lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))
    edges = both.select("graph_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), F.struct(
        F.lit("edge").alias("feature_type"), "u", "v", F.round("length_m", 3).alias("length_m"), "is_bridged", have(e, "is_bridge", F.lit(False)).alias("is_bridge"), F.lit(0.0).alias("edge_betweenness")).alias("properties"))).alias("feature"))
    return nodes.unionByName(edges)


def write_geojson(graph: RoadGraph, path: str, meta: dict | None = None) -> None:
    """One FeatureCollection file; features are streamed to it, not gathered."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", ' + (f'"meta": {json.dumps(meta)}, ' if meta else "") + '"features": [')
        for i, row in enumerate(feature_rows(graph).toLocalIterator()):
            f.write((",\n" if i else "\n") + row["feature"])
        f.write("\n]}\n")


def disabled_features(rows: DataFrame, disabled: DataFrame) -> DataFrame:
    """Feature rows with status ``disabled`` on the given nodes and the edges that touch them."""
    ids = disabled.select(F.col("node_id").alias("_d")).distinct()
    hit = None
    for c in ("node_id", "u", "v"):
        marked = rows.join(ids.withColumnRenamed("_d", c).withColumn(f"_{c}", F.lit(True)), c, "left")
        rows, hit = marked, F.coalesce(F.col(f"_{c}"), F.lit(False)) if hit is None else hit | F.coalesce(F.col(f"_{c}"), F.lit(False))
    return rows.withColumn("status", F.when(hit, "disabled").otherwise(F.col("status"))).drop("_node_id", "_u", "_v")


def write_graphml(graph: RoadGraph, path: str) -> None:
    """GraphML; lines are JSON text."""
    kinds = [("node", c, "double") for c in ("x", "y")] + [("edge", "length_m", "double"), ("edge", "geometry", "string"), ("edge", "is_bridged", "boolean")]
    line = F.to_json(F.transform("geometry", lambda p: F.array(p["x"], p["y"])))
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for where, name, kind in kinds:
            f.write(f'<key id="{name}" for="{where}" attr.name="{name}" attr.type="{kind}"/>\n')
        f.write('<graph edgedefault="undirected">\n')
        for r in graph.nodes.select("node_id", "x", "y").toLocalIterator():
            f.write(f'<node id="{r["node_id"]}"><data key="x">{r["x"]!r}</data><data key="y">{r["y"]!r}</data></node>\n')
        for r in graph.edges.select("u", "v", "length_m", line.alias("line"), "is_bridged").toLocalIterator():
            f.write(f'<edge source="{r["u"]}" target="{r["v"]}"><data key="length_m">{r["length_m"]!r}</data><data key="geometry">{r["line"]}</data><data key="is_bridged">{str(r["is_bridged"]).lower()}</data></edge>\n')
        f.write("</graph>\n</graphml>\n")


def read_graphml(spark: SparkSession, path: str, graph_id: str = "g") -> RoadGraph:
    data = "array<struct<_VALUE:string,_key:string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    value = lambda key: F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]
    nodes = read("node", f"_id long, data {data}").select(F.lit(graph_id).alias("graph_id"), F.col("_id").alias("node_id"), value("x").cast("double").alias("x"), value("y").cast("double").alias("y"))
    line = F.transform(F.from_json(value("geometry"), "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    edges = read("edge", f"_source long, _target long, data {data}").select(F.lit(graph_id).alias("graph_id"), F.col("_source").alias("u"), F.col("_target").alias("v"), value("length_m").cast("double").alias("length_m"), line.alias("geometry"), truthy(value("is_bridged")).alias("is_bridged"))
    return graph_of(nodes, edges)


def read_table(spark: SparkSession, path: str, schema: str = CRITICALITY, required: tuple = ()) -> DataFrame | None:
    """A CSV with header, or None where there is no such file; an error if a required column is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    header = spark.read.csv(path, header=True).columns
    if missing := set(required) - set(header):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return spark.read.csv(path, header=True, schema=schema)


def write_table(df: DataFrame, path: str) -> None:
    """A folder with one CSV file, header first."""
    df.coalesce(1).write.csv(path, header=True, mode="overwrite")


def png_bytes(rows: list) -> bytes:
    """An 8-bit grey PNG of rows of bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]) if rows else 0, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")


def mask_pngs(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """(mask_id, png) of ``pixels(mask_id, row, col)`` with sizes ``masks(mask_id, height, width)``; an empty mask is all zero."""

    def run(key, left, right):
        import numpy as np
        import pandas as pd

        out = []
        for m in right.itertuples(index=False):
            grid = np.zeros((m.height, m.width), np.uint8)
            grid[left["row"].to_numpy(np.int64), left["col"].to_numpy(np.int64)] = 1
            out.append((m.mask_id, png_bytes(list(grid))))
        return pd.DataFrame(out, columns=["mask_id", "png"])

    return pixels.select("mask_id", "row", "col").groupBy("mask_id").cogroup(masks.select("mask_id", "height", "width").groupBy("mask_id")).applyInPandas(run, "mask_id string, png binary")


def read_masks(spark: SparkSession, path: str, above: int = 0) -> DataFrame:
    """(mask_id, row, col) of the pixels brighter than ``above`` of 8-bit grey images; a missing path is an error."""
    images = spark.read.format("image").load(path).select(F.regexp_extract("image.origin", r"([^/]*)\.[^.]*$", 1).alias("mask_id"), "image.width", "image.nChannels", F.hex("image.data").alias("hex"))
    size = F.length("hex") / 2
    cells = images.select("mask_id", "width", "nChannels", F.posexplode(F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda i: F.conv(F.substring("hex", i * 2 + 1, F.lit(2)), 16, 10).cast("int"))).alias("i", "v"))
    cells = cells.where((F.col("i") % F.col("nChannels") == 0) & (F.col("v") > above)).withColumn("i", F.floor(F.col("i") / F.col("nChannels")))
    return cells.select("mask_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("row"), (F.col("i") % F.col("width")).cast("int").alias("col"))


def manifest_alignment(spark: SparkSession, path: str | None) -> tuple | None:
    """The affine of a raster manifest, or None for pixel space."""
    if path is None:
        return None
    row = spark.read.schema("transform array<double>, crs string").json(path, multiLine=True).first()
    return (tuple(row["transform"]), row["crs"]) if row and row["transform"] else None


def grid_graph(spark: SparkSession, side: int, graph_id: str = "grid") -> RoadGraph:
    """A side x side lattice of unit edges, numbered row by row."""
    ids = spark.range(side * side)
    nodes = ids.select(F.lit(graph_id).alias("graph_id"), F.col("id").alias("node_id"), (F.col("id") % side).cast("double").alias("x"), F.floor(F.col("id") / side).cast("double").alias("y"))
    right = ids.where((F.col("id") % side) < side - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    down = ids.where(F.col("id") < side * (side - 1)).select(F.col("id").alias("u"), (F.col("id") + side).alias("v"))
    return graph_of(nodes, right.unionByName(down).withColumn("graph_id", F.lit(graph_id)).withColumn("length_m", F.lit(1.0)))
