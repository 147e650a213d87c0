"""Coordinates: distances, projections, boxes and cells, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SPHERE_M, PLAIN_SPHERE_M, WEB_MERCATOR_M = 6371008.8, 6371000.0, 6378137.0


def valid(lat: Column, lon: Column) -> Column:
    """Both there and in range (FIL04)."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = SPHERE_M) -> Column:
    """Metres on a sphere (FN10); null if a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def x_3857(lon: Column) -> Column:
    return F.radians(lon) * WEB_MERCATOR_M


def y_3857(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * WEB_MERCATOR_M


def planar_3857_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in web-mercator units, longer than metres by 1 / cos(lat) (FN11)."""
    return F.hypot(x_3857(lon2) - x_3857(lon1), y_3857(lat2) - y_3857(lat1))


def tile(metres: Column, size: float = 2000.0) -> Column:
    """Cell number along one axis (FN12)."""
    return F.floor(metres / size)


def grid_id(lat: Column, lon: Column, country: Column) -> Column:
    """One-degree cell, or ``zzz`` and the country without coordinates (SRC06)."""
    cell = F.format_string("g%03d_%03d", F.floor(lat + 90).cast("int"), F.floor(lon + 180).cast("int"))
    return F.when(valid(lat, lon), cell).otherwise(F.concat(F.lit("zzz"), F.lower(F.trim(F.coalesce(country, F.lit(""))))))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a box (FIL05); a box must have south < north and west < east."""
    if not (south < north and west < east):
        raise ValueError("a box needs south < north and west < east")
    south, north, west, east = max(south, -90.0), min(north, 90.0), max(west, -180.0), min(east, 180.0)
    return lat.between(south, north) & lon.between(west, east)


def padded_box(south: float, west: float, north: float, east: float, km: float) -> tuple[float, float, float, float]:
    """A box with ``km`` more on each side (FIL06)."""
    dlat = km / 110.574
    dlon = km / (111.320 * max(0.01, math.cos(math.radians((south + north) / 2))))
    return south - dlat, west - dlon, north + dlat, east + dlon


def distance_status(m: Column) -> Column:
    return F.when(m.isNull(), "missing").when(m <= 250, "supporting").when(m <= 1000, "informational").otherwise("warning")


def distance_label(m: Column) -> Column:
    return F.when(m.isNull(), "missing_coordinates").when(m <= 50, "same_location").when(m <= 250, "nearby").when(m <= 5000, "far_apart").otherwise("too_far")


def distance_score(m: Column) -> Column:
    """FN13."""
    return F.when(m.isNull(), 0.0).when(m <= 50, 1.0).when(m <= 250, 0.85).when(m <= 1000, 0.6).when(m <= 5000, 0.25).otherwise(0.05)


def walk_seconds(m: Column) -> Column:
    """30 to 900 seconds at 1.25 m/s, 120 without a distance (FN14); halves round to even."""
    return F.when(m.isNull(), F.lit(120)).otherwise(F.greatest(F.lit(30), F.least(F.lit(900), F.bround(m / 1.25).cast("int"))))
