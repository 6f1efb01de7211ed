"""Projections and planar geometry as column expressions. Degrees in, feet or metres out, as names say."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257222101
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
SURVEY_FEET_A_METRE = 3937 / 1200
EARTH_RADIUS_FEET = 20_898_071.0

# Lambert conformal conic of the state plane zone (EPSG:2248), Albers of EPSG:3310.
_LCC = {"lat1": 39.45, "lat2": 38.3, "lat0": 37 + 40 / 60, "lon0": -77.0, "x0": 400_000.0}
_ALBERS = {"lat1": 34.0, "lat2": 40.5, "lat0": 0.0, "lon0": -120.0, "y0": -4_000_000.0}


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


def _t(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _q(lat: float) -> float:
    s = math.sin(lat)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def lcc_constants() -> tuple[float, float, float]:
    """(cone constant, radius factor in feet, radius at the origin in feet)."""
    lat1, lat2, lat0 = (math.radians(_LCC[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(_m(lat1)) - math.log(_m(lat2))) / (math.log(_t(lat1)) - math.log(_t(lat2)))
    factor = _A * _m(lat1) / (n * _t(lat1) ** n) * SURVEY_FEET_A_METRE
    return n, factor, factor * _t(lat0) ** n


def albers_constants() -> tuple[float, float, float]:
    """(cone constant, C, radius at the origin in metres)."""
    lat1, lat2, lat0 = (math.radians(_ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    n = (_m(lat1) ** 2 - _m(lat2) ** 2) / (_q(lat2) - _q(lat1))
    c = _m(lat1) ** 2 + n * _q(lat1)
    return n, c, _A * math.sqrt(c - n * _q(lat0)) / n


def lcc_feet(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in US survey feet."""
    n, factor, origin = lcc_constants()
    phi = F.radians(lat)
    s = F.sin(phi) * _E
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    r, theta = F.pow(t, F.lit(n)) * factor, F.radians(lon - _LCC["lon0"]) * n
    return r * F.sin(theta) + _LCC["x0"] * SURVEY_FEET_A_METRE, origin - r * F.cos(theta)


def albers_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    n, c, origin = albers_constants()
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * _E2) - F.log((1 - s * _E) / (1 + s * _E)) / (2 * _E)) * (1 - _E2)
    r, theta = F.sqrt(c - q * n) * (_A / n), F.radians(lon - _ALBERS["lon0"]) * n
    return r * F.sin(theta), origin - r * F.cos(theta) + _ALBERS["y0"]


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance, in the unit of the coordinates."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def planar_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return distance(*albers_metres(lon1, lat1), *albers_metres(lon2, lat2))


def planar_feet(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return distance(*lcc_feet(lon1, lat1), *lcc_feet(lon2, lat2))


def haversine_feet(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = lambda x: F.sin(x / 2) * F.sin(x / 2)
    h = half(p2 - p1) + F.cos(p1) * F.cos(p2) * half(F.radians(lon2 - lon1))
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_RADIUS_FEET)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees, -180 to 180."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))


def known_position(lon: Column, lat: Column) -> Column:
    """A point struct, null where either coordinate is null or zero."""
    return F.when((lon != 0) & (lat != 0), F.struct(lon.alias("lon"), lat.alias("lat")))


def project_line(coords: Column) -> Column:
    """array<struct<lon,lat>> to array<struct<x,y>> in feet."""

    def one(p):
        x, y = lcc_feet(p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(coords, one)


def line_edges(points: Column) -> Column:
    """array of (a, b) points of each edge."""
    pairs = F.zip_with(points, F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(pairs, lambda e: e["b"].isNotNull() & e["a"].isNotNull())


def line_length(points: Column) -> Column:
    steps = F.transform(line_edges(points), lambda e: distance(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def edge_distance(x: Column, y: Column, edge: Column) -> Column:
    """Distance of a point to an edge (a, b)."""
    ax, ay, bx, by = edge["a"]["x"], edge["a"]["y"], edge["b"]["x"], edge["b"]["y"]
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((x - ax) * dx + (y - ay) * dy) / square).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(x, y, ax + dx * t, ay + dy * t)


def line_distance(x: Column, y: Column, points: Column) -> Column:
    """Distance of a point to a line; null for a line without edges."""
    return F.array_min(F.transform(line_edges(points), lambda e: edge_distance(x, y, e)))


def line_ends(points: Column) -> Column:
    """Two rows' worth of (location, point): the first and the last vertex."""
    end = lambda name, p: F.struct(F.lit(name).alias("location"), p.alias("point"))
    return F.array(end("first", F.element_at(points, 1)), end("last", F.element_at(points, -1)))


def polylines(points: DataFrame, keys: Sequence[str], order: str, lon: str, lat: str) -> DataFrame:
    """keys and coords: each group's points joined to a line by order; points without a place are left out."""
    placed = points.where(known_position(F.col(lon), F.col(lat)).isNotNull())
    own = F.struct(F.col(order).alias("at"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    line = F.transform(F.array_sort(F.collect_list(own)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return placed.groupBy(*keys).agg(line.alias("coords"))


def signed_offset_feet(lon0: Column, lat0: Column, lon: Column, lat: Column, towards: Column) -> Column:
    """Feet from a start point, negative where the point lies behind it: over 90 degrees off the bearing ``towards``."""
    off, feet = F.abs(bearing(lon0, lat0, lon, lat) - towards), haversine_feet(lon0, lat0, lon, lat)
    return F.when((F.least(off, 360 - off) > 90) & (feet > 0), -feet).otherwise(feet)


def link_line(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """A line of two points."""
    return F.array(F.struct(lon1.alias("lon"), lat1.alias("lat")), F.struct(lon2.alias("lon"), lat2.alias("lat")))
