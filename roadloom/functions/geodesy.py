"""Map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 ellipsoid, UTM scale and false easting, spherical Mercator radius.
A, FLATTENING, K0, EASTING, MERCATOR_RADIUS = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 6378137.0

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def _central(zone) -> Column:
    return F.radians((zone if isinstance(zone, Column) else F.lit(zone)) * 6.0 - 183.0)


def to_utm(lon: Column, lat: Column, zone, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) by the Krueger series to fourth order."""
    phi, lam = F.radians(lat), F.radians(lon) - _central(zone)
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + K0 * _RECTIFYING * x, (1e7 if south else 0.0) + K0 * _RECTIFYING * y


def from_utm(x: Column, y: Column, zone, south: bool = False) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi = (y - (1e7 if south else 0.0)) / (K0 * _RECTIFYING)
    eta = (x - EASTING) / (K0 * _RECTIFYING)
    a, b = xi, eta
    for j, beta in enumerate(_BETA, 1):
        a = a - beta * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - beta * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(_central(zone) + F.atan2(F.sinh(b), F.cos(a))), F.degrees(phi)


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres about an origin; 111320 and 110540 metres a degree are fixed values."""
    return (lon - lon0) * 111320.0 * F.cos(F.radians(lat0)), (lat - lat0) * 110540.0


def tile_number(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional XYZ tile coordinates."""
    n = float(2**zoom)
    return (lon + 180.0) / 360.0 * n, (1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n


def tile_to_mercator(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator metres of an XYZ tile coordinate."""
    half = math.pi * MERCATOR_RADIUS
    span = 2 * half / 2**zoom
    return x * span - half, half - y * span


def pixel_to_world(row: Column, col: Column, transform: Column | None = None, resolution: float = 1.0) -> tuple[Column, Column]:
    """Pixel centre by an affine struct<a,b,c,d,e,f>; without one, plain multiples of the resolution."""
    if transform is None:
        return col * resolution, row * resolution
    c, r = col + 0.5, row + 0.5
    return transform["a"] * c + transform["b"] * r + transform["c"], transform["d"] * c + transform["e"] * r + transform["f"]


def grid_shape(x_min: Column, y_min: Column, x_max: Column, y_max: Column, resolution: float) -> tuple[Column, Column]:
    """(width, height) of a north-up grid over a box, at least 1 each."""
    return F.greatest(F.lit(1), F.ceil((x_max - x_min) / resolution)).cast("int"), F.greatest(F.lit(1), F.ceil((y_max - y_min) / resolution)).cast("int")


def north_up_grid(west: Column, south: Column, east: Column, north: Column, resolution: float = 1.0) -> Column:
    """struct(zone, width, height, left, top): the metric grid over a lon/lat box in the UTM zone of its middle."""
    zone = utm_zone((west + east) / 2)
    # The corners of a box in the south get the false northing of 10,000 km.
    shift = F.when((south + north) / 2 < 0, 1e7).otherwise(0.0)
    corners = [to_utm(lon, lat, zone) for lon in (west, east) for lat in (south, north)]
    xs, ys = [c[0] for c in corners], [c[1] + shift for c in corners]
    width, height = grid_shape(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys), resolution)
    return F.struct(zone.alias("zone"), width.alias("width"), height.alias("height"), F.least(*xs).alias("left"), F.greatest(*ys).alias("top"))
