"""Planar geometry as column expressions: points are struct<x,y>, lines arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.alias("y"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def polyline_length(line: Column) -> Column:
    """Sum of the segment lengths; 0 for fewer than two vertices."""
    n = F.size(line)
    steps = F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), distance)
    return F.when(n < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d))


def unit(dx: Column, dy: Column) -> Column:
    """The unit vector, or null for one shorter than 1e-12."""
    norm = F.sqrt(dx * dx + dy * dy)
    return F.when(norm >= 1e-12, F.struct((dx / norm).alias("x"), (dy / norm).alias("y")))


def turn_angle(heading: Column, dx: Column, dy: Column) -> Column:
    """Degrees between a unit heading and a vector; 0 where either is undefined."""
    norm = F.sqrt(dx * dx + dy * dy)
    cosine = (heading["x"] * dx + heading["y"] * dy) / norm
    return F.when(heading.isNull() | (norm < 1e-12), 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def oriented(line: Column, start: Column) -> Column:
    """The line turned so that it starts at its end nearer to ``start``."""
    first, last = F.element_at(line, 1), F.element_at(line, -1)
    return F.when(distance(first, start) > distance(last, start), F.reverse(line)).otherwise(line)


def stitched(a: Column, b: Column) -> Column:
    """One line after the other, the shared vertex once."""
    return F.concat(a, F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))))


def outward_heading(line: Column, node: Column) -> Column:
    """Unit direction in which a line leaves the network at its end ``node``: from the last vertex apart from it."""
    path = oriented(line, node)
    here = F.element_at(path, 1)
    apart = F.filter(path, lambda p: distance(p, here) > 1e-9)
    other = F.get(apart, F.lit(0))
    return F.when(other.isNotNull(), unit(here["x"] - other["x"], here["y"] - other["y"]))


def bezier_bridge(a: Column, b: Column, heading_a: Column, heading_b: Column, samples: int = 9) -> Column:
    """Cubic Bezier from a to b leaving along the headings, handles a third of the gap; straight where a heading is null."""
    handle = distance(a, b) / 3
    c1 = F.struct((a["x"] + heading_a["x"] * handle).alias("x"), (a["y"] + heading_a["y"] * handle).alias("y"))
    c2 = F.struct((b["x"] + heading_b["x"] * handle).alias("x"), (b["y"] + heading_b["y"] * handle).alias("y"))

    def at(i):
        t = i / F.lit(float(samples - 1))
        s = 1 - t
        mix = lambda k: s * s * s * a[k] + 3 * s * s * t * c1[k] + 3 * s * t * t * c2[k] + t * t * t * b[k]
        return F.struct(mix("x").alias("x"), mix("y").alias("y"))

    curve = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), at)
    return F.when(heading_a.isNull() | heading_b.isNull(), F.array(a, b)).otherwise(curve)


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]], boundary: bool) -> Column:
    """Even-odd test against a closed ring; points on the boundary count as ``boundary`` says."""
    corners = list(ring)
    if corners[0] == corners[-1]:
        corners = corners[:-1]
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
            crossings = crossings + F.when(((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < at), 1).otherwise(0)
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        within = x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
        on_edge = on_edge | (within & (F.abs(cross) <= 1e-12))
    odd = F.pmod(crossings, F.lit(2)) == 1
    return (odd | on_edge) if boundary else (odd & ~on_edge)


def douglas_peucker(points: list, tolerance: float) -> list:
    """The vertices kept (kernel for Arrow batches); ends always stay."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        lo, hi = stack.pop()
        (x1, y1), (x2, y2) = points[lo], points[hi]
        dx, dy = x2 - x1, y2 - y1
        norm = (dx * dx + dy * dy) ** 0.5
        far, at = -1.0, None
        for i in range(lo + 1, hi):
            px, py = points[i][0] - x1, points[i][1] - y1
            if norm:
                t = max(0.0, min(1.0, (px * dx + py * dy) / (norm * norm)))
                d = ((px - t * dx) ** 2 + (py - t * dy) ** 2) ** 0.5
            else:
                d = (px * px + py * py) ** 0.5
            if d > far:
                far, at = d, i
        if at is not None and far > tolerance:
            keep.add(at)
            stack += [(lo, at), (at, hi)]
    return [points[i] for i in sorted(keep)]
