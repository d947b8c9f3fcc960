"""Geometry as column expressions (JVM-side, whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of `radius`; arguments are columns, column names or numbers in degrees; null without one of them."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # rounding may exceed 1 for antipodes; null and NaN stay what they are
    return F.lit(2 * radius) * F.asin(F.when((a > 1.0) & (a < 4.0), 1.0).otherwise(F.sqrt(a)))


def equirectangular_m(lat1, lon1, lat2, lon2, metres_per_degree: float = 111_000.0) -> Column:
    """Planar distance: degrees times 111 km, longitudes shrunk by the cosine of the first latitude."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dy = (lat2 - lat1) * metres_per_degree
    dx = (lon2 - lon1) * metres_per_degree * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Planar initial bearing in [0, 360), null for coincident points."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(~same, F.pmod(F.degrees(F.atan2(lon2 - lon1, lat2 - lat1)) + 360.0, F.lit(360.0)))


def angle_difference(a, b) -> Column:
    """Difference of two directions in [0, 180]."""
    return F.abs(F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0)


def parallel_delta(a, b) -> Column:
    """Difference of two axes (direction ignored) in [0, 90]."""
    d = angle_difference(a, b)
    return F.least(d, F.abs(180.0 - d))


def perpendicular_delta(a, b) -> Column:
    """How far two axes are from a right angle, in [0, 90]."""
    return F.abs(parallel_delta(a, b) - 90.0)


def crossing_angle_ok(road, crossing, delta=30.0, low=None, high=None) -> Column:
    """With bounds: the axis difference lies in [low, high]; else it is within `delta` of a right angle."""
    d = angle_difference(road, crossing)
    if low is not None and high is not None:
        return d.between(_c(low), _c(high))
    return F.abs(F.least(d, 180.0 - d) - 90.0) <= _c(delta)


def segment_ratio(px, py, ax, ay, bx, by) -> Column:
    """Position of the projection of P on AB, clamped to [0, 1]; 0 for a segment without length."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    return F.when(t.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Planar distance of P from the segment AB, in the unit of the coordinates."""
    t = segment_ratio(px, py, ax, ay, bx, by)
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), 2) + F.pow(py - (ay + t * (by - ay)), 2))


def bbox_radius_m(south, west, north, east) -> Column:
    """Largest great-circle distance from the centre of a box to its corners."""
    south, west, north, east = map(_c, (south, west, north, east))
    lat, lon = (south + north) / 2, (west + east) / 2
    return F.greatest(*(haversine_m(lat, lon, a, b) for a in (south, north) for b in (west, east)))


def virtual_node_id(lat, lon) -> Column:
    """Id of a snapped home: '999' and both coordinates as digits of 1e-7 degrees; a string, for it exceeds 64 bits."""
    digits = lambda x: F.abs(F.round(_c(x) * 1e7).cast("bigint")).cast("string")
    return F.concat(F.lit("999"), digits(lat), digits(lon))
