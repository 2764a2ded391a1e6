"""Raster operators on pixel tables: a mask is the set of its road pixels (mask_id, row, col)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.topology import components
from roadloom.storage import checkpoint

EIGHT = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))
FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))


def offsets(steps) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))


def disk(radius: int) -> tuple:
    return tuple((a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius)


def spread(pixels: DataFrame, steps) -> DataFrame:
    """Every pixel moved by every step; as many rows as pixels times steps."""
    rest = [c for c in pixels.columns if c not in ("row", "col")]
    moved = pixels.withColumn("_s", F.explode(offsets(steps)))
    return moved.select(*rest, (F.col("row") + F.col("_s.a")).alias("row"), (F.col("col") + F.col("_s.b")).alias("col"))


def tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels with their tile and their place in it; edge tiles are padded by what is absent."""
    if size <= 0:
        raise ValueError("tile size must be positive")
    div = lambda c: F.floor(F.col(c) / size).cast("int")
    return pixels.select("mask_id", div("row").alias("tile_row"), div("col").alias("tile_col"), (F.col("row") % size).alias("row"), (F.col("col") % size).alias("col"))


def tile_summary(pixels: DataFrame, size: int, min_fraction: float = 0.0) -> DataFrame:
    """(mask_id, tile_row, tile_col, y0, x0, road_px) of the tiles with at least ``min_fraction`` road."""
    counts = tiles(pixels, size).groupBy("mask_id", "tile_row", "tile_col").agg(F.count("*").alias("road_px"))
    counts = counts.withColumn("y0", F.col("tile_row") * size).withColumn("x0", F.col("tile_col") * size)
    return counts.where(F.col("road_px") / F.lit(float(size * size)) >= min_fraction)


def stitched_tiles(tiled: DataFrame, size: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Tile pixels back in place; what lies beyond the raster (padding) goes."""
    out = tiled.select("mask_id", (F.col("tile_row") * size + F.col("row")).alias("row"), (F.col("tile_col") * size + F.col("col")).alias("col"))
    inside = F.lit(True)
    if height is not None:
        inside = inside & (F.col("row") < height)
    if width is not None:
        inside = inside & (F.col("col") < width)
    return out.where(inside)


def neighbour_counts(pixels: DataFrame, steps=EIGHT) -> DataFrame:
    """Road pixels with the number of road pixels around them."""
    around = spread(pixels.select("mask_id", "row", "col"), steps).groupBy("mask_id", "row", "col").agg(F.count("*").alias("neighbours"))
    return pixels.join(around, ["mask_id", "row", "col"], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def dilate(pixels: DataFrame, steps) -> DataFrame:
    return spread(pixels, steps).distinct()


def erode(pixels: DataFrame, steps) -> DataFrame:
    """Pixels all of whose steps are road; what lies outside the raster is not."""
    steps = tuple(steps)
    back = spread(pixels, [(-a, -b) for a, b in steps])
    return back.groupBy("mask_id", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == len(steps)).select("mask_id", "row", "col")


def within(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return pixels.where((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))


def opened(pixels: DataFrame, radius: int) -> DataFrame:
    return pixels if radius <= 0 else dilate(erode(pixels, disk(radius)), disk(radius))


def closed(pixels: DataFrame, radius: int) -> DataFrame:
    return pixels if radius <= 0 else erode(dilate(pixels, disk(radius)), disk(radius))


def pixel_components(pixels: DataFrame, steps=EIGHT, stride: int = 1 << 20) -> DataFrame:
    """Pixels with the smallest pixel number (row * stride + col) of their component."""
    named = checkpoint(pixels.select("mask_id", "row", "col").distinct().withColumn("node_id", F.col("row").cast("long") * stride + F.col("col")))
    ids = named.select(F.col("mask_id").alias("graph_id"), "node_id")
    half = [(a, b) for a, b in steps if (a, b) > (0, 0)]
    moved = spread(named.select("mask_id", "row", "col", "node_id"), half).withColumnRenamed("node_id", "u")
    links = moved.join(named.withColumnRenamed("node_id", "v"), ["mask_id", "row", "col"]).select(F.col("mask_id").alias("graph_id"), "u", "v")
    labels = components(ids, links).withColumnRenamed("graph_id", "mask_id")
    return named.join(labels, ["mask_id", "node_id"]).select("mask_id", "row", "col", "component")


def without_small(pixels: DataFrame, min_size: int = 50, steps=EIGHT) -> DataFrame:
    """Without components of fewer than ``min_size`` pixels."""
    labels = checkpoint(pixel_components(pixels, steps))
    big = labels.groupBy("mask_id", "component").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return labels.join(big, ["mask_id", "component"], "left_semi").select("mask_id", "row", "col")


def background(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """The pixels of ``masks(mask_id, height, width)`` that are not road."""
    every = masks.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return every.select("mask_id", "row", "col").join(pixels.select("mask_id", "row", "col"), ["mask_id", "row", "col"], "left_anti")


def filled_holes(pixels: DataFrame, masks: DataFrame, area: int = 50) -> DataFrame:
    """Background components below ``area`` pixels become road."""
    labels = checkpoint(pixel_components(background(pixels, masks), FOUR))
    small = labels.groupBy("mask_id", "component").agg(F.count("*").alias("n")).where(F.col("n") < area)
    holes = labels.join(small, ["mask_id", "component"], "left_semi").select("mask_id", "row", "col")
    return pixels.select("mask_id", "row", "col").unionByName(holes)


def cleaned(pixels: DataFrame, masks: DataFrame, min_size: int = 50, open_radius: int = 0, close_radius: int = 0, fill: int = 0) -> DataFrame:
    """Opening, closing, small components, holes, in that order, as the operators above do them; a task holds a mask's pixels."""
    if max(min_size, open_radius, close_radius, fill) <= 0:
        return pixels

    def run(key, left, right):
        import numpy as np
        import pandas as pd

        sizes = [] if fill <= 0 or key[0] is None else list(zip(right["height"].tolist(), right["width"].tolist()))
        row, col = (np.append(left[c].to_numpy(dtype="int64"), [0, *(s[i] for s in sizes)]) for i, c in enumerate(("row", "col")))
        # Pixels are numbered row by row, with room about them for what the steps reach.
        room = 1 + 2 * max(open_radius, close_radius, 0)
        top, first = row.min() - room, col.min() - room
        wide = col.max() - first + room + 1
        number = lambda r, c: (r - top) * wide + (c - first)
        own = np.unique(number(row, col)[: len(left)])
        for radius, grows in ((open_radius, (False, True)), (close_radius, (True, False))):
            steps = [a * wide + b for a, b in disk(radius)] if radius > 0 else []
            for grow in grows if steps else ():
                own = np.unique(np.concatenate([own + s for s in steps])) if grow else own[np.logical_and.reduce([among(own, own + s) for s in steps])]
        if min_size > 0:
            own = own[:0] if key[0] is None else own[_pieces(own, wide, EIGHT) >= min_size]
        if sizes:
            free = np.unique(np.concatenate([number(*(x.ravel() for x in np.indices((max(h, 0), max(w, 0))))) for h, w in sizes]))
            free = free[~among(own, free)]
            own = np.concatenate((own, free[_pieces(free, wide, FOUR) < fill]))
        out = pd.DataFrame({"row": own // wide + top, "col": own % wide + first})
        out.insert(0, "mask_id", pd.Series([key[0]] * len(own), dtype=object))
        return out

    types = dict(pixels.dtypes)
    pixels = pixels.select("mask_id", "row", "col").where("row is not null and col is not null")
    # Only holes need the sizes, and masks without a pixel.
    masks = masks.select("mask_id", "height", "width") if fill > 0 else pixels.select("mask_id", F.lit(0).alias("height"), F.lit(0).alias("width")).limit(0)
    return pixels.groupBy("mask_id").cogroup(masks.groupBy("mask_id")).applyInPandas(lambda key, left, right: run(key, left, right), f"mask_id {types['mask_id']}, row {types['row']}, col {types['col']}")


def among(numbers, asked):
    """Which of ``asked`` are among the sorted ``numbers``."""
    import numpy as np

    if not len(numbers):
        return np.zeros(len(asked), bool)
    at = np.searchsorted(numbers, asked)
    return numbers[np.minimum(at, len(numbers) - 1)] == asked


def _pieces(numbers, wide: int, steps):
    """How many pixels the component of each has, of sorted pixel ``numbers`` (row * wide + col)."""
    import numpy as np

    ends = []
    for step in (a * wide + b for a, b in steps if (a, b) > (0, 0)):
        there = among(numbers, numbers + step)
        ends.append((np.flatnonzero(there), np.searchsorted(numbers, numbers[there] + step)))
    a, b = (np.concatenate(x) for x in zip(*ends))
    label = np.arange(len(numbers))
    while (label[a] != label[b]).any():
        one, other = label[a], label[b]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while (label[label] != label).any():
            label = label[label]
    return np.bincount(label, minlength=len(numbers))[label]


def without_spurs(pixels: DataFrame, longest: int = 5) -> DataFrame:
    """Without dead-end branches of at most ``longest`` pixels that lead to a branch point.

    Paths grow from the ends a pixel a round; one that meets a branch point in time goes.
    With ``longest`` below 1 all pixels stay.
    """
    if longest < 1:
        return pixels.select("mask_id", "row", "col")
    marked = checkpoint(neighbour_counts(pixels))
    paths = marked.where("neighbours = 1").select("mask_id", "row", "col", F.array(F.struct("row", "col")).alias("path"))
    gone = None
    for _ in range(longest):
        ahead = spread(paths, EIGHT).join(marked, ["mask_id", "row", "col"]).where(~F.array_contains("path", F.struct("row", "col")))
        ahead = checkpoint(ahead)
        hit = ahead.where("neighbours >= 3").select("mask_id", F.explode("path").alias("p")).select("mask_id", "p.row", "p.col")
        gone = hit if gone is None else gone.unionByName(hit)
        met = ahead.where("neighbours >= 3").select("mask_id", "path").distinct()
        on = ahead.where("neighbours = 2").join(met, ["mask_id", "path"], "left_anti")
        paths = on.select("mask_id", "row", "col", F.concat("path", F.array(F.struct("row", "col"))).alias("path"))
    return marked.select("mask_id", "row", "col").join(gone.distinct(), ["mask_id", "row", "col"], "left_anti")


def soft_erode(values: DataFrame) -> DataFrame:
    """Least value of the plus-shaped neighbourhood of ``values(img, row, col, p)``; absent neighbours do not count."""
    return _pooled(values, ((0, 0), *FOUR), F.min)


def soft_dilate(values: DataFrame) -> DataFrame:
    return _pooled(values, ((0, 0), *EIGHT), F.max)


def _pooled(values: DataFrame, steps, pool) -> DataFrame:
    pools = spread(values, steps).groupBy("img", "row", "col").agg(pool("p").alias("p"))
    return pools.join(values.select("img", "row", "col"), ["img", "row", "col"], "left_semi")


def soft_skeleton_grid(image, there, rounds: int):
    """Soft skeleton of a 2-D array whose cells are ``there``; absent ones do not count."""
    import numpy as np

    def pooled(grid, steps, pool):
        wide, (h, w) = np.pad(np.where(there, grid, np.nan), 1, constant_values=np.nan), grid.shape
        out = grid
        for a, b in steps:
            out = pool(out, wide[1 + a : 1 + a + h, 1 + b : 1 + b + w])
        return out

    skeleton = None
    for i in range(rounds + 1):
        image = pooled(image, FOUR, np.fmin) if i else image
        delta = np.fmax(image - pooled(pooled(image, FOUR, np.fmin), EIGHT, np.fmax), 0.0)
        skeleton = delta if skeleton is None else skeleton + np.fmax(delta - skeleton * delta, 0.0)
    return skeleton


def gridded(pdf, *columns):
    """Which cells of an image's rows are there, its columns as grids (absent: nan), and the rows' places in them."""
    import numpy as np

    row, col = (pdf[c].to_numpy() - pdf[c].min() for c in ("row", "col"))
    there = np.zeros((int(row.max()) + 1, int(col.max()) + 1), bool)
    there[row, col] = True
    grids = []
    for c in columns:
        grid = np.full(there.shape, np.nan)
        grid[row, col] = pdf[c].to_numpy(dtype="float64")
        grids.append(grid)
    return there, grids, (row, col)


def soft_skeleton(values: DataFrame, rounds: int = 3) -> DataFrame:
    """Soft skeleton of ``values(img, row, col, p)``: what openings lose, gathered over erosions; a task holds an image."""

    def run(pdf):
        there, (grid,), at = gridded(pdf, "p")
        return pdf.assign(p=soft_skeleton_grid(grid, there, rounds)[at])

    values = values.select("img", "row", "col", F.col("p").cast("double").alias("p"))
    return values.groupBy("img").applyInPandas(run, values.schema)


#: Places for cells that a task has found touched; rows and cells that it looks at in one go.
FOUND, ROWS_AT_ONCE, CELLS_AT_ONCE = 1 << 20, 1 << 18, 1 << 20


def rasterized(segments: DataFrame, width_m: float, resolution: float = 1.0, height: int | None = None, width: int | None = None) -> DataFrame:
    """Cells touched by lines of width ``width_m``: ``segments(mask_id, x1, y1, x2, y2)`` in grid metres (y down) to pixels.

    A cell is touched if its square comes within half the width of the segment. A task
    passes over cells that it has found touched before, so of many segments over one
    place few are worked out, and few rows are left to be made distinct.
    """

    def run(batches):
        import pandas as pd

        cells = TouchedCells(width_m / 2, resolution, height, width)
        for batch in batches:
            for mask, row, col in cells.of(batch["mask_id"], *(batch[c].to_numpy(dtype="float64") for c in ("x1", "y1", "x2", "y2"))):
                yield pd.DataFrame({"mask_id": mask, "row": row, "col": col})

    kind = dict(segments.dtypes)["mask_id"]
    ends = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    finite = " and ".join(f"{c} is not null and abs({c}) < double('infinity')" for c in ("x1", "y1", "x2", "y2"))
    return segments.select("mask_id", *ends).where(finite).mapInPandas(run, f"mask_id {kind}, row int, col int").distinct()


class TouchedCells:
    """The cells that segments touch, each at least once and seldom again."""

    def __init__(self, half: float, resolution: float, height: int | None = None, width: int | None = None):
        import numpy as np

        self.half, self.resolution, self.height, self.width = half, resolution, height, width
        self.masks: dict = {}
        # Of the cells that share a place the last one is kept; any other may come again.
        self.cell, self.mask = np.zeros(FOUND, np.int64), np.full(FOUND, -1, np.int32)

    def of(self, names, x1, y1, x2, y2):
        """(mask_ids, rows, cols) of cells that were not known as touched."""
        import numpy as np
        import pandas as pd

        codes, unique = pd.factorize(names, use_na_sentinel=False)
        numbers = np.array([self.masks.setdefault(None if pd.isna(u) else u, len(self.masks)) for u in unique], np.int32)[codes]
        each = list(self.masks)
        place = lambda v: np.floor(v / self.resolution).astype(np.int64)
        spans = []
        for a, b, end in ((y1, y2, self.height), (x1, x2, self.width)):
            low, high = place(np.minimum(a, b) - self.half), place(np.maximum(a, b) + self.half)
            spans.append((np.maximum(low, 0), high if end is None else np.minimum(high, end - 1)))
        (top, bottom), (left, right) = spans
        many, wide = np.maximum(bottom - top + 1, 0), np.maximum(right - left + 1, 0)
        for lo, hi in _shares(many, ROWS_AT_ONCE):
            at = np.repeat(np.arange(lo, hi), many[lo:hi])
            row = np.arange(len(at)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi]) + top[at]
            for a, b in _shares(wide[at], CELLS_AT_ONCE):
                w = wide[at[a:b]]
                one, r = np.repeat(at[a:b], w), np.repeat(row[a:b], w)
                c = np.arange(len(one)) - np.repeat(np.cumsum(w) - w, w) + left[one]
                cell, mask = (r << 32) | c, numbers[one]
                spot = ((cell.view(np.uint64) + mask.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - FOUND.bit_length())).astype(np.int64)
                new = np.flatnonzero((self.cell[spot] != cell) | (self.mask[spot] != mask))
                one, r, c = one[new], r[new], c[new]
                new = new[touches(x1[one], y1[one], x2[one], y2[one], r, c, self.half, self.resolution)]
                if len(new):
                    found = np.unique(np.stack((mask[new], cell[new], spot[new])), axis=1)
                    self.mask[found[2]], self.cell[found[2]] = found[0], found[1]
                    yield [each[m] for m in found[0].tolist()], (found[1] >> 32).astype(np.int32), (found[1] & 0xFFFFFFFF).astype(np.int32)


def _shares(counts, most: int):
    """Ranges whose counts add up to ``most`` at the most, or a single one."""
    import numpy as np

    upto, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(upto, most + (upto[a - 1] if a else 0), side="right")))
        yield a, b
        a = b


def touches(x1, y1, x2, y2, row, col, half: float, resolution: float):
    """Whether the square of a cell comes within ``half`` of a segment."""
    import numpy as np

    left, top = col * resolution, row * resolution
    right, bottom = left + resolution, top + resolution
    corners = ((left, top), (right, top), (right, bottom), (left, bottom))
    dx, dy = x2 - x1, y2 - y1
    norm = dx * dx + dy * dy
    long = np.where(norm > 0, norm, 1.0)

    def to_point(px, py):
        """Squared distance of a point to the segment."""
        t = np.where(norm > 0, np.maximum(0.0, np.minimum(1.0, ((px - x1) * dx + (py - y1) * dy) / long)), 0.0)
        ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
        return ex * ex + ey * ey

    def to_square(px, py):
        ex = np.maximum(np.maximum(left - px, 0.0), px - right)
        ey = np.maximum(np.maximum(top - py, 0.0), py - bottom)
        return ex * ex + ey * ey

    sides = [dx * (py - y1) - dy * (px - x1) for px, py in corners]
    least, most = (f.reduce(sides) for f in (np.minimum, np.maximum))
    boxes = (np.minimum(x1, x2) <= right) & (np.maximum(x1, x2) >= left) & (np.minimum(y1, y2) <= bottom) & (np.maximum(y1, y2) >= top)
    nearest = np.minimum.reduce([*(to_point(px, py) for px, py in corners), to_square(x1, y1), to_square(x2, y2)])
    return (boxes & (least <= 0) & (most >= 0)) | (nearest <= half * half)


def resampled_nearest(pixels: DataFrame, factor: float, height: int, width: int) -> DataFrame:
    """Road pixels of a raster scaled by ``factor`` to height x width, by the nearest source pixel."""
    out = pixels.withColumn("r", F.explode(F.sequence(F.floor(F.col("row") * factor).cast("int"), F.ceil((F.col("row") + 1) * factor).cast("int"))))
    out = out.withColumn("c", F.explode(F.sequence(F.floor(F.col("col") * factor).cast("int"), F.ceil((F.col("col") + 1) * factor).cast("int"))))
    out = out.where((F.floor(F.col("r") / factor) == F.col("row")) & (F.floor(F.col("c") / factor) == F.col("col")))
    return out.where((F.col("r") < height) & (F.col("c") < width)).select("mask_id", F.col("r").alias("row"), F.col("c").alias("col")).distinct()


def sampled_bilinear(values: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets(img, row, col, sy, sx)`` with the bilinear value of ``values(img, row, col, p)`` at source place (sy, sx); outside pixels count 0."""
    fy, fx = F.floor("sy").cast("int"), F.floor("sx").cast("int")
    corners = targets.withColumn("_s", F.explode(offsets(((0, 0), (0, 1), (1, 0), (1, 1)))))
    wy = F.when(F.col("_s.a") == 0, 1 - (F.col("sy") - fy)).otherwise(F.col("sy") - fy)
    wx = F.when(F.col("_s.b") == 0, 1 - (F.col("sx") - fx)).otherwise(F.col("sx") - fx)
    corners = corners.select("img", F.col("row").alias("tr"), F.col("col").alias("tc"), (fy + F.col("_s.a")).alias("row"), (fx + F.col("_s.b")).alias("col"), (wy * wx).alias("w"))
    found = corners.join(values, ["img", "row", "col"], "left")
    return found.groupBy("img", F.col("tr").alias("row"), F.col("tc").alias("col")).agg(F.sum(F.col("w") * F.coalesce("p", F.lit(0.0))).alias("p"))


def window_starts(length: int, tile: int, stride: int) -> list[int]:
    """Starts of overlapping windows over a length, the last one flush with its end."""
    if length <= tile:
        return [0]
    starts = list(range(0, length - tile, stride))
    return [*starts, length - tile]


def blended(predictions: DataFrame, tile: int) -> DataFrame:
    """Windows' predictions ``(img, y0, x0, row, col, p)`` (row and col within the window) blended by Hann weights, 0.05 at least each way."""
    hann = lambda c: 0.5 - 0.5 * F.cos(2 * math.pi * F.col(c) / (tile - 1)) + 0.05
    placed = predictions.withColumn("w", hann("row") * hann("col"))
    placed = placed.groupBy("img", (F.col("y0") + F.col("row")).alias("y"), (F.col("x0") + F.col("col")).alias("x")).agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))
    return placed.withColumnsRenamed({"y": "row", "x": "col"})


def dihedral(values: DataFrame, size: int) -> DataFrame:
    """``values(img, row, col, p)`` of a square under its eight symmetries, numbered ``view``."""
    r, c, n = F.col("row"), F.col("col"), F.lit(size - 1)
    views = [(r, c), (r, n - c), (n - r, c), (n - r, n - c), (c, r), (c, n - r), (n - c, r), (n - c, n - r)]
    view = F.array(*(F.struct(F.lit(i).alias("view"), a.alias("row"), b.alias("col")) for i, (a, b) in enumerate(views)))
    return values.select("img", "p", F.explode(view).alias("v")).select("img", "v.view", "v.row", "v.col", "p")


def undone_dihedral(views: DataFrame, size: int) -> DataFrame:
    """Mean of the views turned back."""
    r, c, n = F.col("row"), F.col("col"), F.lit(size - 1)
    back = [(r, c), (r, n - c), (n - r, c), (n - r, n - c), (c, r), (n - c, r), (c, n - r), (n - c, n - r)]
    place = None
    for i, (a, b) in enumerate(back):
        s = F.struct(a.alias("row"), b.alias("col"))
        place = F.when(F.col("view") == i, s) if place is None else place.when(F.col("view") == i, s)
    return views.select("img", place.alias("at"), "p").groupBy("img", "at.row", "at.col").agg(F.avg("p").alias("p"))


def percentile_stretch(values: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``values(chip, channel, row, col, v)`` stretched to 0..255 between two percentiles of each channel; a flat channel is divided by 1."""
    bounds = values.groupBy("chip", "channel").agg(F.percentile("v", low).alias("lo"), F.percentile("v", high).alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / span)) * 255
    return values.join(bounds, ["chip", "channel"]).select("chip", "channel", "row", "col", F.floor(scaled).cast("int").alias("v"))


def otsu(values: DataFrame, bins: int = 256) -> DataFrame:
    """(img, threshold): the bin centre with the greatest variance between the classes; null for a constant image."""
    ends = values.groupBy("img").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    binned = values.join(ends.where("hi > lo"), "img").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int"))
    counts = binned.groupBy("img", "bin", "lo", "hi").agg(F.count("*").alias("n"))
    counts = counts.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    upto, whole = Window.partitionBy("img").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("img")
    counts = counts.withColumn("w0", F.sum("n").over(upto)).withColumn("m0", F.sum(F.col("n") * F.col("centre")).over(upto))
    counts = counts.withColumn("w", F.sum("n").over(whole)).withColumn("m", F.sum(F.col("n") * F.col("centre")).over(whole))
    other = F.col("w") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / F.when(other > 0, other)
    split = counts.where("w > w0").withColumn("between", F.col("w0") * other * gap * gap)
    best = split.groupBy("img").agg(F.max(F.struct("between", -F.col("bin"), "centre")).alias("b")).select("img", F.col("b.centre").alias("threshold"))
    return ends.select("img").join(best, "img", "left")


def first_tiles(summary: DataFrame, most: int) -> DataFrame:
    """The first ``most`` tiles in reading order over all masks: a stop after enough tiles."""
    return summary.orderBy("mask_id", "tile_row", "tile_col").limit(most)


#: The channel means and deviations image networks are trained with.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalised(values: DataFrame) -> DataFrame:
    """``values(img, channel, row, col, v)`` with z: scaled to 0..1 where the image exceeds 1, then centred and scaled by channel."""
    top = values.groupBy("img").agg(F.max("v").alias("_top"))
    pick = lambda table: F.element_at(F.array(*(F.lit(x) for x in table)), F.col("channel") + 1)
    scaled = F.when(F.col("_top") > 1.0, F.col("v") / 255.0).otherwise(F.col("v"))
    return values.join(top, "img").withColumn("z", (scaled - pick(CHANNEL_MEAN)) / pick(CHANNEL_STD)).drop("_top")


def multi_scale(maps: list[DataFrame]) -> DataFrame:
    """The mean of probability maps ``(img, row, col, p)`` that were predicted at several scales and brought to one size."""
    out = maps[0]
    for other in maps[1:]:
        out = out.unionByName(other)
    return out.groupBy("img", "row", "col").agg(F.avg("p").alias("p"))
