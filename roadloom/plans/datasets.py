"""Training tiles from rasters and road vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geodesy import local_metres, to_utm, utm_zone
from roadloom.operators import raster


def line_segments(roads: DataFrame) -> DataFrame:
    """``roads(mask_id, geometry)`` cut into segments; null, empty and single-point lines go."""
    n = F.size("geometry")
    pairs = F.zip_with(F.slice("geometry", F.lit(1), n - 1), F.slice("geometry", F.lit(2), n - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return roads.where(n > 1).select("mask_id", F.explode(pairs).alias("s")).select("mask_id", "s.*")


def utm_segments(segments: DataFrame, zone: int | None = None, south: bool = False) -> DataFrame:
    """Segments from lon/lat to UTM metres; without a zone, that of each segment's start."""
    z = F.lit(zone) if zone is not None else utm_zone(F.col("x1"))
    a, b = to_utm(F.col("x1"), F.col("y1"), z, south), to_utm(F.col("x2"), F.col("y2"), z, south)
    return segments.select("mask_id", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))


def grid_segments(segments: DataFrame, x0: float, y1: float) -> DataFrame:
    """World metres to grid metres of a north-up raster whose top left corner is (x0, y1)."""
    return segments.select("mask_id", (F.col("x1") - x0).alias("x1"), (y1 - F.col("y1")).alias("y1"), (F.col("x2") - x0).alias("x2"), (y1 - F.col("y2")).alias("y2"))


def metric_segments(segments: DataFrame, lon0: float, lat0: float) -> DataFrame:
    a, b = local_metres(F.col("x1"), F.col("y1"), F.lit(lon0), F.lit(lat0)), local_metres(F.col("x2"), F.col("y2"), F.lit(lon0), F.lit(lat0))
    return segments.select("mask_id", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))


def tile_pairs(labels: DataFrame, images: DataFrame, size: int = 512, min_fraction: float = 0.005) -> DataFrame:
    """Tiles with enough road that also have imagery: ``labels(mask_id, row, col)`` and ``images(mask_id, tile_row, tile_col, ...)``."""
    return raster.tile_summary(labels, size, min_fraction).join(images, ["mask_id", "tile_row", "tile_col"])


def upsampled_tiles(pixels: DataFrame, factor: float, height: int, width: int, size: int = 512, min_fraction: float = 0.005) -> DataFrame:
    return raster.tile_summary(raster.resampled_nearest(pixels, factor, height, width), size, min_fraction)


def manifest(pixels: DataFrame, size: int) -> DataFrame:
    """(mask_id, densest, n_tiles, tiles): what a mask's tiles hold, as one row a mask."""
    summary = raster.tile_summary(pixels, size)
    tile = F.struct("tile_row", "tile_col", "y0", "x0", "road_px")
    return summary.groupBy("mask_id").agg(F.max_by(tile, F.struct("road_px", -F.col("tile_row"), -F.col("tile_col"))).alias("densest"), F.count("*").alias("n_tiles"), F.sort_array(F.collect_list(tile)).alias("tiles"))


def tile_cover(boxes: DataFrame) -> DataFrame:
    """``boxes(name, x0, y0, x1, y1)`` in fractional tile numbers to the tiles that cover them."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b)).cast("int"), F.floor(F.greatest(a, b)).cast("int")))
    return boxes.withColumn("tx", span("x0", "x1")).withColumn("ty", span("y0", "y1")).select("name", "tx", "ty")


def truth_graph_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Street edges with any ids to a simple graph: ids by order from 0, no loops, the shortest of parallel edges."""
    ids = edges.select(F.explode(F.array("u", "v")).alias("old")).distinct()
    ids = ids.withColumn("node_id", (F.row_number().over(Window.orderBy("old")) - 1).cast("long"))
    out = edges.where("u <> v")
    for end in ("u", "v"):
        out = out.join(ids.select(F.col("old").alias(end), F.col("node_id").alias(f"_{end}")), end)
    rest = [c for c in edges.columns if c not in ("u", "v")]
    out = out.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"), *rest)
    best = out.groupBy("u", "v").agg(F.min_by(F.struct(*rest), "length_m").alias("e")).select("u", "v", "e.*")
    return ids, best


def segmentation_report(meta: DataFrame, keep: tuple = ()) -> DataFrame:
    """Scores of ``meta`` to 4 decimals, null where a key is missing; the columns of ``keep`` go with them."""
    names = ("iou", "dice", "occlusion_recall", "threshold")
    return meta.select(*keep, *(F.round(F.col(c), 4).alias(c) if c in meta.columns else F.lit(None).cast("double").alias(c) for c in names))
