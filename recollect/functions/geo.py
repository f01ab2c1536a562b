"""Geographic functions on degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M = 6_371_008.8, 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(p1) * F.cos(p2) * t * t
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def is_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def radius_box(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """(south, west, north, east) around a circle; what a scan can push down."""
    dlat = radius_m / DEGREE_M
    dlon = radius_m / (DEGREE_M * max(1e-6, math.cos(math.radians(lat))))
    return lat - dlat, lon - dlon, lat + dlat, lon + dlon


def morton(lat: Column, lon: Column, bits: int = 26) -> Column:
    """Interleaved cell number; nearby points sort near each other."""
    top = (1 << bits) - 1
    y = F.least(F.floor((lat + 90) / 180 * (top + 1)), F.lit(top)).cast("bigint")
    x = F.least(F.floor((lon + 180) / 360 * (top + 1)), F.lit(top)).cast("bigint")
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(1), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(1), 2 * i + 1))
    return out
