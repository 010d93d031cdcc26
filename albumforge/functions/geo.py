"""Distances and coordinate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    # Antipodes may round a hair above 1. A missing coordinate has to stay missing, which least() would not do.
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def coordinate_key(lat: Column, lng: Column) -> Column:
    """Both coordinates with 3 decimals: about 100 m."""
    return F.format_string("%.3f,%.3f", lat, lng)
