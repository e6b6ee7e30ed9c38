"""Distances, boxes and grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, KM_A_DEGREE, M_A_DEGREE = 6371.0, 111.32, 111320.0  # fixed values, as is the least cosine of 0.2 below


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.lit(EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


HAVERSINE_SQL = "2*6371.0*asin(least(1.0, sqrt(pow(sin(radians({b}lat-{a}lat)/2),2)+cos(radians({a}lat))*cos(radians({b}lat))*pow(sin(radians({b}lon-{a}lon)/2),2))))"


def cosine_km(lat0: float, lon0: float, lat: Column, lon: Column) -> Column:
    """Distance from a fixed point by the law of cosines."""
    a, o = F.radians(F.lit(lat0)), F.radians(F.lit(lon0))
    inner = F.cos(a) * F.cos(F.radians(lat)) * F.cos(F.radians(lon) - o) + F.sin(a) * F.sin(F.radians(lat))
    return F.lit(EARTH_KM) * F.acos(F.least(F.lit(1.0), inner))


def cosine_sql(lat0: float, lon0: float) -> str:
    return f"6371.0*acos(least(1.0, cos(radians(CAST({lat0} AS DOUBLE)))*cos(radians(lat))*cos(radians(lon)-radians(CAST({lon0} AS DOUBLE)))+sin(radians(CAST({lat0} AS DOUBLE)))*sin(radians(lat))))"


def degrees_of(km: Column, lat: Column) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of a box of ``km`` around a point."""
    return km / KM_A_DEGREE, km / (F.lit(KM_A_DEGREE) * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive; a row without coordinates is outside."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def in_area(lat: Column, lon: Column, radius_km: Column, area: tuple[float, float, float, float]) -> Column:
    """Inside the rectangle widened by the row's own margin: its radius, 1 km at least. Null without coordinates."""
    south, west, north, east = area
    margin = F.greatest(F.lit(1.0), F.coalesce(radius_km, F.lit(0.0)))
    centre = (south + north) / 2
    d_lat, d_lon = degrees_of(margin, F.lit(round(centre, 5)))
    return (lat >= F.lit(south) - d_lat) & (lat <= F.lit(north) + d_lat) & (lon >= F.lit(west) - d_lon) & (lon <= F.lit(east) + d_lon)


def segment_metres(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def neighbours(cell: Column, reach: int = 1) -> Column:
    return F.explode(F.array(*[cell + k for k in range(-reach, reach + 1)]))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def round5(x: Column) -> Column:
    return F.floor(x * 100_000 + 0.5) / 100_000


def centre(south: Column, west: Column, north: Column, east: Column) -> tuple[Column, Column]:
    """The rectangle's middle, to five decimals."""
    return round5((south + north) / 2), round5((west + east) / 2)


def covering_radius_km(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Whole kilometres of the circle around the centre that covers the rectangle, one at least."""
    lat, lon = centre(south, west, north, east)
    return F.greatest(F.lit(1), F.ceil(haversine_km(lat, lon, north, east))).cast("int")


def size_km(south: Column, west: Column, north: Column, east: Column) -> tuple[Column, Column]:
    """Width and height through the centre."""
    lat, lon = centre(south, west, north, east)
    return haversine_km(lat, west, lat, east), haversine_km(south, lon, north, lon)


def around(lat: Column, lon: Column, km: Column) -> tuple[Column, Column, Column, Column]:
    """The square of ``km`` to every side of a point, to five decimals."""
    d_lat, d_lon = degrees_of(km, lat)
    return round5(lat - d_lat), round5(lon - d_lon), round5(lat + d_lat), round5(lon + d_lon)


def expand(south: Column, west: Column, north: Column, east: Column, km: Column) -> tuple[Column, Column, Column, Column]:
    """The rectangle with a margin of ``km``."""
    d_lat, d_lon = degrees_of(km, centre(south, west, north, east)[0])
    return south - d_lat, west - d_lon, north + d_lat, east + d_lon


def snap_up(km: Column, allowed: list[int]) -> Column:
    """The smallest allowed value that isn't below, else the largest."""
    values = F.array(*map(F.lit, allowed))
    return F.coalesce(F.array_min(F.filter(values, lambda x: x >= km)), F.array_max(values))
