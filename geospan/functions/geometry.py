"""Geometry as column expressions: distances, polygon measures, boxes, rays, projections and text forms.

Rings are arrays of points ``array<struct<x: double, y: double>>``, closed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return radius * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


HEURISTICS = {"euclidean": euclidean, "manhattan": manhattan, "haversine": haversine, "none": lambda *_: F.lit(0.0)}


def heuristic(name: str):
    if name not in HEURISTICS:
        raise ValueError(f"Unknown heuristic: {name}")
    return HEURISTICS[name]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))


def _edges(ring: Column) -> Column:
    """Consecutive points of a ring."""
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, e: s + of(e))


def signed_area(ring: Column) -> Column:
    return _sum(_edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def length(ring: Column) -> Column:
    return _sum(_edges(ring), lambda e: F.sqrt((e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"])))


def centroid(ring: Column) -> Column:
    """Area-weighted."""
    a6 = signed_area(ring) * 6
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    return point(_sum(_edges(ring), lambda e: (e["x1"] + e["x2"]) * cross(e)) / a6, _sum(_edges(ring), lambda e: (e["y1"] + e["y2"]) * cross(e)) / a6)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting with half-open edges."""
    crossed = F.filter(_edges(ring), lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] == e["y1"], 1.0).otherwise(e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / F.when(union > 0, union).otherwise(1.0)).otherwise(0.0)


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def point_buffer(x: Column, y: Column, distance: float, resolution: int = 16) -> Column:
    """A ring of 4 * resolution corners around a point."""
    n = 4 * resolution
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(x + distance * F.cos((i % n) * (2 * math.pi / n)), y + distance * F.sin((i % n) * (2 * math.pi / n))))


_R = 6378137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * _R, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * _R


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / _R), F.degrees(2 * F.atan(F.exp(y / _R)) - math.pi / 2)


# The ellipsoid of WGS 84, and the scale and shifts of the transverse zones.
_A, _FLAT, _SCALE, _EAST, _SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = _FLAT / (2 - _FLAT)
_MEAN = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_zone(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:326xx (north) or 327xx: transverse Mercator by its series, to a millimetre within a zone."""
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(zone * 6 - 183)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _EAST + _SCALE * _MEAN * x, (_SOUTH if south else 0.0) + _SCALE * _MEAN * y


def from_zone(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    xi, eta = (y - (_SOUTH if south else 0.0)) / (_SCALE * _MEAN), (x - _EAST) / (_SCALE * _MEAN)
    u, v = xi, eta
    for j, b in enumerate(_BACK, 1):
        u, v = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_LATITUDE, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183.0), F.degrees(phi)


def projection(code: int):
    """``(forward, backward)`` between EPSG:4326 and another system: 4326, 3857, 326xx and 327xx."""
    if code == 4326:
        return (lambda x, y: (x, y)), (lambda x, y: (x, y))
    if code == 3857:
        return to_mercator, from_mercator
    zone, south = code % 100, code // 100 == 327
    if code // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{code} is not known here")
    return (lambda x, y: to_zone(x, y, zone, south)), (lambda x, y: from_zone(x, y, zone, south))


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one system in another, by way of EPSG:4326."""
    return projection(target)[0](*projection(source)[1](x, y))


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def from_point_wkt(wkt: Column) -> Column:
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    return point(F.regexp_extract(wkt, pattern, 1).try_cast("double"), F.regexp_extract(wkt, pattern, 2).try_cast("double"))


def point_feature(x: Column, y: Column, properties: Column, key: Column | None = None) -> Column:
    """A GeoJSON feature; a null id is left out."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x.cast("double"), y.cast("double")).alias("coordinates"))
    fields = [F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")]
    return F.to_json(F.struct(*fields, *([key.alias("id")] if key is not None else [])))


def ring_feature(ring: Column, properties: Column) -> Column:
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))
