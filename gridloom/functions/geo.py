"""Distances and directions on the sphere, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
WALK_M_PER_MIN = 80.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 <= b < 360, clockwise from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def compass(degrees: Column) -> Column:
    """The nearest of eight directions."""
    index = F.floor(F.pmod(degrees + F.lit(22.5), F.lit(360.0)) / F.lit(45.0)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), index + 1)


def minutes(metres: Column, m_per_min: float = WALK_M_PER_MIN) -> Column:
    return metres / F.lit(m_per_min)
