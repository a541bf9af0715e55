"""Distances, bearings and grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.config import EARTH_KM, KM_PER_DEGREE


def flat_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, at: Column | None = None) -> Column:
    """Equirectangular distance; the cosine is taken at latitude `at`, or midway."""
    at = (lat1 + lat2) / F.lit(2.0) if at is None else at
    return F.lit(KM_PER_DEGREE) * F.sqrt(F.pow((lon1 - lon2) * F.cos(F.radians(at)), F.lit(2.0)) + F.pow(lat1 - lat2, F.lit(2.0)))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360, on the flat approximation."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / F.lit(2.0)))
    return F.pmod(F.degrees(F.atan2(dx, lat2 - lat1)), F.lit(360.0))


def octant(degrees: Column) -> Column:
    """0 = north, 2 = east, ..."""
    return F.pmod(F.floor((degrees + 22.5) / 45.0), F.lit(8)).cast("int")


def angle_between(a: Column, b: Column) -> Column:
    """Absolute difference of two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed bounds: west, south, east, north."""
    w, s, e, n = box
    return lon.between(w, e) & lat.between(s, n)


def grown_box(box: tuple[float, float, float, float], km: float) -> tuple[float, float, float, float]:
    from math import cos, radians

    w, s, e, n = box
    dy, dx = km / KM_PER_DEGREE, km / (KM_PER_DEGREE * cos(radians((s + n) / 2)))
    return w - dx, s - dy, e + dx, n + dy


def edge_km(lon: Column, lat: Column, box: tuple[float, float, float, float], per_lon: float = 69.4, per_lat: float = 111.3) -> Column:
    """Distance to the nearest side of the box."""
    w, s, e, n = box
    return F.least((lon - w) * per_lon, (F.lit(e) - lon) * per_lon, (lat - s) * per_lat, (F.lit(n) - lat) * per_lat)


def grid_square(east: Column, north: Column) -> Column:
    """Two letters of the 100 km square and the 10 km digits of British National Grid metres."""
    e, n = F.floor(east / 100_000).cast("int"), F.floor(north / 100_000).cast("int")
    letters = F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ")
    first = (F.lit(19) - n) - F.pmod(F.lit(19) - n, F.lit(5)) + F.floor((e + 10) / 5).cast("int")
    second = F.pmod((F.lit(19) - n) * 5, F.lit(25)) + F.pmod(e, F.lit(5))
    pick = lambda i: F.substring(letters, i.cast("int") + 1, F.lit(1))
    tens = lambda v: F.floor(F.pmod(v, F.lit(100_000)) / 10_000).cast("int").cast("string")
    return F.concat(pick(first), pick(second), tens(east), tens(north))


def british_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres: transverse Mercator on the Airy ellipsoid after a three-parameter shift of datum (a few metres)."""
    # Ellipsoids, datum shift and projection.
    a1, f1 = 6378137.0, 1 / 298.257223563
    a, b, k0, lat0, lon0, e0, n0 = 6377563.396, 6356256.909, 0.9996012717, 49.0, -2.0, 400000.0, -100000.0
    shift = (-375.0, 111.0, -431.0)
    e1 = 2 * f1 - f1 * f1
    e2 = 1 - (b * b) / (a * a)
    p, q = F.radians(lat), F.radians(lon)
    v1 = F.lit(a1) / F.sqrt(1 - F.lit(e1) * F.pow(F.sin(p), F.lit(2.0)))
    x, y, z = v1 * F.cos(p) * F.cos(q) + shift[0], v1 * F.cos(p) * F.sin(q) + shift[1], v1 * (1 - e1) * F.sin(p) + shift[2]
    r = F.sqrt(x * x + y * y)
    phi = F.atan2(z, r * (1 - e2))
    for _ in range(4):
        v = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.pow(F.sin(phi), F.lit(2.0)))
        phi = F.atan2(z + F.lit(e2) * v * F.sin(phi), r)
    lam = F.atan2(y, x) - F.radians(F.lit(lon0))
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    v = F.lit(a * k0) / F.sqrt(1 - F.lit(e2) * s * s)
    rho = F.lit(a * k0 * (1 - e2)) / F.pow(1 - F.lit(e2) * s * s, F.lit(1.5))
    eta = v / rho - 1
    n = (a - b) / (a + b)
    d, m = phi - F.radians(F.lit(lat0)), phi + F.radians(F.lit(lat0))
    arc = F.lit(b * k0) * (
        F.lit(1 + n + 1.25 * n**2 + 1.25 * n**3) * d - F.lit(3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(m)
        + F.lit(1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * m) - F.lit(35 / 24 * n**3) * F.sin(3 * d) * F.cos(3 * m)
    )
    l2 = lam * lam
    north = arc + F.lit(n0) + l2 * (v / 2 * s * c) + l2 * l2 * (v / 24 * s * F.pow(c, F.lit(3.0)) * (5 - t * t + 9 * eta))
    east = F.lit(e0) + lam * (v * c) + lam * l2 * (v / 6 * F.pow(c, F.lit(3.0)) * (v / rho - t * t))
    return east, north
