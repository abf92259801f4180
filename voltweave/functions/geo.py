"""Geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_KM, SOUTH_RING

#: Kilometres of a degree of latitude.
DEGREE_KM = math.pi * EARTH_KM / 180


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in km."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    y, x = F.sin((b - a) / 2), F.sin((F.radians(lon_b) - F.radians(lon_a)) / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), y * y + F.cos(a) * F.cos(b) * x * x)))


def in_ring(lon: Column, lat: Column, ring=SOUTH_RING) -> Column:
    """Whether a point is inside a fixed ring: an odd number of edges cross the ray to the east."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, (*ring[1:], ring[0])):
        between = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        crossings = crossings + F.when(between & (lon < F.lit(x2 - x1) * (lat - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1)), 1).otherwise(0)
    return crossings % 2 == 1


def island(lon: Column, lat: Column) -> Column:
    return F.when(in_ring(lon, lat), "South").otherwise("North")


def first_vertex(parts: Column) -> Column:
    """First vertex of a polyline given as parts of vertices."""
    return F.element_at(F.element_at(parts, 1), 1)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """(lon, lat) centroid of a closed ring of structs (lon, lat), weighted by area; of a ring without area the mean."""
    pairs = F.zip_with(ring, F.slice(ring, F.lit(2), F.size(ring)), lambda p, q: F.struct(p["lon"].alias("x"), p["lat"].alias("y"), q["lon"].alias("u"), q["lat"].alias("v")))
    pairs = F.filter(pairs, lambda s: s["u"].isNotNull())
    cross = lambda s: s["x"] * s["v"] - s["u"] * s["y"]
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + f(s))
    area = total(cross)
    mean = lambda axis: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(ring)
    x = F.when(area == 0, mean("lon")).otherwise(F.try_divide(total(lambda s: (s["x"] + s["u"]) * cross(s)), area * 3))
    y = F.when(area == 0, mean("lat")).otherwise(F.try_divide(total(lambda s: (s["y"] + s["v"]) * cross(s)), area * 3))
    return x, y


def node_key(lat: Column, lon: Column, decimals: int = 5) -> Column:
    """A coordinate rounded to ``decimals``, as one number."""
    scale = 10**decimals
    y, x = F.bround(lat * scale).cast("long"), F.bround(lon * scale).cast("long")
    return (y + 90 * scale) * (400 * scale) + (x + 180 * scale)


def parse_node(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of a node named "(lat, lon)"; null if it is no coordinate."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    pattern = rf"^\(\s*{number}\s*,\s*{number}\s*\)$"
    ok = text.rlike(pattern)
    return tuple(F.when(ok, F.regexp_extract(text, pattern, k).cast("double")) for k in (1, 2))


# Fixed values of the Transverse Mercator zones: central meridian, scale, false easting, false northing; GRS80/WGS84 ellipsoid.
ZONES = {2193: (173.0, 0.9996, 1600000.0, 10000000.0), 32760: (177.0, 0.9996, 500000.0, 10000000.0)}
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101


def _series() -> tuple[float, float, list[float], list[float]]:
    """Eccentricity, rectifying radius and Krueger's forward and inverse coefficients to the fourth order of n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return math.sqrt(FLATTENING * (2 - FLATTENING)), radius, alpha, beta


def project(lat: Column, lon: Column, epsg: int) -> tuple[Column, Column]:
    """(easting, northing) in metres of WGS84 degrees."""
    e, radius, alpha, _ = _series()
    meridian, scale, east, north = ZONES[epsg]
    s, d = F.sin(F.radians(lat)), F.radians(lon - meridian)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    y = xi + sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(alpha, 1)), F.lit(0.0))
    x = eta + sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(alpha, 1)), F.lit(0.0))
    return x * (scale * radius) + east, y * (scale * radius) + north


def unproject(easting: Column, northing: Column, epsg: int) -> tuple[Column, Column]:
    """(lat, lon) in WGS84 degrees of metres."""
    e, radius, _, beta = _series()
    meridian, scale, east, north = ZONES[epsg]
    xi, eta = (northing - north) / (scale * radius), (easting - east) / (scale * radius)
    y = xi - sum((b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(beta, 1)), F.lit(0.0))
    x = eta - sum((b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(beta, 1)), F.lit(0.0))
    s = F.sin(y) / F.cosh(x)
    psi = F.atanh(s)
    q = psi
    for _ in range(6):  # the isometric latitude, solved by fixed-point steps
        q = psi + e * F.atanh(e * F.tanh(q))
    return F.degrees(F.asin(F.tanh(q))), F.degrees(F.atan2(F.sinh(x), F.cos(y))) + meridian
