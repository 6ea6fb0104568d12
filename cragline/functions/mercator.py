"""Web Mercator, tile pyramids and great-circle distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres.
RADIUS, HALF_WORLD, MEAN_RADIUS = 6378137.0, math.pi * 6378137.0, 6371008.8
TILE = 256


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return RADIUS * F.radians(lon), RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def from_tile(zoom: Column, tx: Column, ty: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place (u, v), each 0..1, in a tile; v runs to the south."""
    size = 2 * HALF_WORLD / F.pow(F.lit(2.0), zoom)
    return from_mercator((tx + u) * size - HALF_WORLD, HALF_WORLD - (ty + v) * size)


def metres_per_pixel(zoom: Column) -> Column:
    return 2 * HALF_WORLD / TILE / F.pow(F.lit(2.0), zoom)


def to_pixel(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    x, y = to_mercator(lon, lat)
    return (x + HALF_WORLD) / metres_per_pixel(zoom), (HALF_WORLD - y) / metres_per_pixel(zoom)


def zoom_for(target: Column, lowest: int = 0, highest: int = 20) -> Column:
    """The first zoom whose resolution is target metres a pixel or finer; the highest one if none is, or target <= 0."""
    fine = F.filter(F.sequence(F.lit(lowest), F.lit(highest)), lambda z: metres_per_pixel(z) <= target)
    return F.coalesce(F.when(target > 0, F.get(fine, F.lit(0))), F.lit(highest))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def utm_epsg(lon_min: Column, lon_max: Column, lat_mid: Column) -> Column:
    """EPSG number of the UTM zone of a box; null where it is wider than 6 degrees or beyond -80..84."""
    zone = F.least(F.floor(((lon_min + lon_max) / 2 + 180) / 6) + 1, F.lit(60))
    return F.when((lon_max - lon_min <= 6) & lat_mid.between(-80, 84), F.when(lat_mid >= 0, 32600 + zone).otherwise(32700 + zone))
