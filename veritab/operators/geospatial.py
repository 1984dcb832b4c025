"""Coordinates, boxes, distances and polygons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.checks import Check, Measure, count_if, outside, per_column

# Least and greatest latitude, least and greatest longitude.
REGIONS = {"world": (-90.0, 90.0, -180.0, 180.0), "europe": (34.0, 72.0, -25.0, 45.0), "north_america": (7.0, 84.0, -170.0, -50.0), "south_america": (-56.0, 13.0, -82.0, -34.0), "asia": (-11.0, 82.0, 25.0, 180.0), "africa": (-35.0, 38.0, -18.0, 52.0), "oceania": (-48.0, 0.0, 110.0, 180.0)}
COUNTRIES = {"KR": (33.0, 38.7, 124.5, 132.0), "JP": (24.0, 46.0, 122.0, 154.0), "CN": (18.0, 54.0, 73.0, 135.0), "US": (24.5, 49.4, -125.0, -66.9), "DE": (47.2, 55.1, 5.8, 15.1), "FR": (41.3, 51.1, -5.2, 9.6), "GB": (49.9, 60.9, -8.2, 1.8), "BR": (-33.8, 5.3, -73.9, -34.8), "IN": (6.5, 35.7, 68.1, 97.4), "AU": (-43.7, -10.7, 113.2, 153.7)}


def _box(name: str, lat_column: str, lon_column: str, box: tuple[float, float, float, float], issue: str) -> Check:
    lat, lon = F.col(lat_column), F.col(lon_column)
    return Check(name, lambda df: [Measure(name, f"{lat_column},{lon_column}", issue, count_if(~geo.in_box(lat, lon, box)), count_if(lat.isNotNull() & lon.isNotNull()))])


def geo_bounding_box(lat_column: str, lon_column: str, box: tuple[float, float, float, float] | None = None, region: str | None = None) -> Check:
    return _box("geo_bounding_box", lat_column, lon_column, box or REGIONS[region or "world"], "outside_box")


def geo_country(lat_column: str, lon_column: str, country: str) -> Check:
    return _box("geo_country", lat_column, lon_column, COUNTRIES[country], "outside_country")


def latitude(column: str, min_lat: float = -90.0, max_lat: float = 90.0) -> Check:
    return per_column("latitude", column, "numeric", lambda c, x: Measure("latitude", c, "invalid_latitude", count_if(~x.between(min_lat, max_lat)), F.count(x)))


def longitude(column: str, min_lon: float = -180.0, max_lon: float = 180.0) -> Check:
    return per_column("longitude", column, "numeric", lambda c, x: Measure("longitude", c, "invalid_longitude", count_if(~x.between(min_lon, max_lon)), F.count(x)))


def coordinate(lat_column: str, lon_column: str) -> Check:
    lat, lon = F.col(lat_column), F.col(lon_column)
    return Check("coordinate", lambda df: [Measure("coordinate", lat_column, "invalid_latitude", count_if(~lat.between(-90, 90)), F.count(lat)), Measure("coordinate", lon_column, "invalid_longitude", count_if(~lon.between(-180, 180)), F.count(lon))])


def coordinate_not_null_island(lat_column: str, lon_column: str, tolerance: float = 0.0) -> Check:
    lat, lon = F.col(lat_column), F.col(lon_column)
    return Check("coordinate_not_null_island", lambda df: [Measure("coordinate_not_null_island", f"{lat_column},{lon_column}", "null_island", count_if((F.abs(lat) <= tolerance) & (F.abs(lon) <= tolerance)), count_if(lat.isNotNull() & lon.isNotNull()))])


def _distance(name: str, column: str, distance: Column, low, high) -> Check:
    return Check(name, lambda df: [Measure(name, column, "distance_out_of_range", count_if(outside(distance, low, high) == 1), F.count(distance))])


def geo_distance(lat1: str, lon1: str, lat2: str, lon2: str, min_distance: float | None = None, max_distance: float | None = None, unit: str = "km", name: str = "geo_distance") -> Check:
    """Rows whose two points are too near or too far; ``optimized_geo_distance`` is the same plan."""
    return _distance(name, f"{lat1},{lon1},{lat2},{lon2}", geo.haversine(*map(F.col, (lat1, lon1, lat2, lon2)), unit), min_distance, max_distance)


def geo_distance_from_point(lat_column: str, lon_column: str, ref_lat: float, ref_lon: float, min_distance: float | None = None, max_distance: float | None = None, unit: str = "km") -> Check:
    return _distance("geo_distance_from_point", f"{lat_column},{lon_column}", geo.haversine(F.col(lat_column), F.col(lon_column), F.lit(ref_lat), F.lit(ref_lon), unit), min_distance, max_distance)


def polygon(lat_column: str, lon_column: str, wkt: str) -> Check:
    return multi_polygon(lat_column, lon_column, [wkt], name="polygon")


def multi_polygon(lat_column: str, lon_column: str, wkts: Sequence[str], require_all: bool = False, name: str = "multi_polygon") -> Check:
    """Points outside all polygons, or, with ``require_all``, outside any."""
    lat, lon = F.col(lat_column), F.col(lon_column)
    hits = [geo.inside(lat, lon, geo.rings(w)) for w in wkts]
    good = reduce(lambda a, b: a & b if require_all else a | b, hits)
    there = lat.isNotNull() & lon.isNotNull()
    return Check(name, lambda df: [Measure(name, f"{lat_column},{lon_column}", "outside_polygon", count_if(~good), count_if(there))])


def polygon_distance(lat_column: str, lon_column: str, wkt: str, max_distance_km: float | None = None, min_distance_km: float | None = None) -> Check:
    """Planar distance to a polygon, 0 inside."""
    lat, lon, shape = F.col(lat_column), F.col(lon_column), geo.rings(wkt)
    distance = F.when(geo.inside(lat, lon, shape), 0.0).otherwise(geo.degrees_to_edge(lat, lon, shape) * geo.KM_PER_DEGREE)
    return _distance("polygon_distance", f"{lat_column},{lon_column}", distance, min_distance_km, max_distance_km)
