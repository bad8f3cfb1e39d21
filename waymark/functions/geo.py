"""Planar and geodetic expressions over coordinate columns (degrees or metres)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres a degree of longitude at the equator, and of latitude, in the local equirectangular frame.
DEGREE_LON_M, DEGREE_LAT_M = 111_320.0, 110_540.0


def to_plane(lon: Column, lat: Column, at_lat: float) -> tuple[Column, Column]:
    """x, y in metres of the equirectangular frame at ``at_lat``."""
    return lon * (DEGREE_LON_M * math.cos(math.radians(at_lat))), lat * DEGREE_LAT_M


def from_plane(x: Column, y: Column, at_lat: float) -> tuple[Column, Column]:
    return x / (DEGREE_LON_M * math.cos(math.radians(at_lat))), y / DEGREE_LAT_M


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The clamped share t of the way from a to b that is nearest to p; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    return F.when(long == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / long, F.lit(0.0)), F.lit(1.0)))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along_segment(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross at a place inside both: each has its ends on either side of the other."""
    rx, ry = b[0] - a[0], b[1] - a[1]
    ux, uy, vx, vy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    return ((ux * ry - uy * rx) * (ux * (ry + vy) - uy * (rx + vx)) < 0) & ((vx * -ry - vy * -rx) * (vx * (uy - ry) - vy * (ux - rx)) < 0)


def segments_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of two segments (x1, y1, x2, y2): zero if they cross, else the least end-to-segment distance."""

    def side(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    cross = (side(*a, *b[:2]) * side(*a, *b[2:]) < 0) & (side(*b, *a[:2]) * side(*b, *a[2:]) < 0)
    ends = [point_segment_distance(*p, *s) for p, s in ((a[:2], b), (a[2:], b), (b[:2], a), (b[2:], a))]
    return F.when(cross, F.lit(0.0)).otherwise(F.least(*ends))


def close_to(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """|a - b| <= absolute + relative * |b|."""
    return F.abs(a - b) <= F.lit(absolute) + F.lit(relative) * F.abs(b)


def node_key(x: Column, places: int = 3) -> Column:
    """A coordinate snapped to ``places`` decimals, as a whole number."""
    return F.round(x * 10**places).cast("long")


# Transverse Mercator on WGS84 by Krueger's series in the third flattening, to the third order.
_A, _N = 6_378_137.0, (1 / 298.257223563) / (2 - 1 / 298.257223563)
_RECTIFIED = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATS = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_SCALE = 0.9996


def to_utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Easting and northing in metres of a UTM zone."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    conformal = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(conformal, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + conformal * conformal))
    x, y = eta, xi
    for k, c in enumerate(_FORWARD, 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.lit(500_000.0) + _SCALE * _RECTIFIED * x, F.lit(10_000_000.0 if south else 0.0) + _SCALE * _RECTIFIED * y


def from_utm(easting: Column, northing: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi0, eta0 = (northing - (10_000_000.0 if south else 0.0)) / (_SCALE * _RECTIFIED), (easting - 500_000.0) / (_SCALE * _RECTIFIED)
    xi, eta = xi0, eta0
    for k, c in enumerate(_BACK, 1):
        xi = xi - c * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - c * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for k, c in enumerate(_LATS, 1):
        lat = lat + c * F.sin(2 * k * chi)
    return F.lit(6.0 * zone - 183) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)
