"""Scalar functions of the trajectory engine, all as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d = F.radians(lon2 - lon1)
    x = F.sin(d) * F.cos(F.radians(lat2))
    y = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0))


def angle_difference(a: Column, b: Column) -> Column:
    """Smallest difference of two bearings, in [0, 180]."""
    return F.abs(F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0)


def bearing_sin_cos(b: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(b)), F.cos(F.radians(b))


def enu(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Spherical point in metres east, north and up of an anchor."""
    la, lo, la0, lo0 = F.radians(lat), F.radians(lon), math.radians(lat0), math.radians(lon0)
    x, y, z = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
    dx, dy, dz = (EARTH_RADIUS_M * (p - q) for p, q in ((x, math.cos(la0) * math.cos(lo0)), (y, math.cos(la0) * math.sin(lo0)), (z, math.sin(la0))))
    east = -math.sin(lo0) * dx + math.cos(lo0) * dy
    north = -math.sin(la0) * math.cos(lo0) * dx - math.sin(la0) * math.sin(lo0) * dy + math.cos(la0) * dz
    up = math.cos(la0) * math.cos(lo0) * dx + math.cos(la0) * math.sin(lo0) * dy + math.sin(la0) * dz
    return F.struct(east.alias("x"), north.alias("y"), up.alias("z"))


def metres_to_degrees(north: Column, east: Column, lat: Column) -> tuple[Column, Column]:
    return north / METRES_PER_DEGREE, east / (METRES_PER_DEGREE * F.greatest(F.lit(1e-6), F.cos(F.radians(lat))))


def displacement_bin(d: Column) -> Column:
    edges = (10, 25, 50, 100, 200)
    out = F.when(d <= 1e-6, "zero")
    for low, high in zip((0, *edges), edges, strict=False):
        out = out.when(d < high, f"{low}-{high}")
    return out.when(d.isNotNull(), "200+")


def feature_category(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n.isNotNull(), "4+")


def nearly_equal(a: Column, b: Column, atol: float, rtol: float) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def relative_position(offset: Column, n: Column) -> Column:
    return offset / F.greatest(n - 1, F.lit(1))


def position_bucket(p: Column) -> Column:
    return F.when(p < 1 / 3, "early").when(p < 2 / 3, "middle").when(p.isNotNull(), "late")


def hash_draw(k: int, bound: Column, *parts: Column) -> Column:
    """A reproducible whole number in [0, bound) from SHA-256 of the parts and k."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(k))), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), bound)


def safe_ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(n / d)


def speed_class(v: Column) -> Column:
    return F.when(v < 10, "<10").when(v < 20, "10-20").when(v < 30, "20-30").when(v.isNotNull(), ">=30")


def parse_boolean(c: Column) -> Column:
    """Three-valued: true, 1, yes / false, 0, no / unknown."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes"), F.lit(True)).when(t.isin("false", "0", "no"), F.lit(False))


def ratio_reason(d: Column) -> Column:
    return F.when(d == 0, "zero_denominator").otherwise("")


def log_score(c: Column) -> Column:
    return F.log10(1 + c)


def seed_for(seed: int, source: Column, kind: str, number: int = 1) -> Column:
    """The first eight bytes of the SHA-256 of the JSON list [seed, source, kind, number], as an unsigned number."""
    text = F.concat(F.lit(f'[{seed}, "'), source, F.lit(f'", "{kind}", {number}]'))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def without_reason(reasons: Column, reason: str) -> Column:
    """A ;-joined list without one of its reasons."""
    return F.array_join(F.array_remove(F.split(reasons, ";"), reason), ";")


def sorted_json(m: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
