"""Great-circle geometry and polygons as column expressions; degrees in, kilometres out."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut

EARTH_KM = 6371.0
MILES = 0.621371
KM_PER_DEGREE = 111.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "km") -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(a), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), F.lit(2))
    return 2 * EARTH_KM * (MILES if unit == "miles" else 1.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360 degrees."""
    d, p, q = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing_: Column, km: Column) -> Column:
    """The point at a bearing and distance, a struct of ``lat`` and ``lon``."""
    p, t, d = F.radians(lat), F.radians(bearing_), km / EARTH_KM
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    lon2 = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), (F.pmod(F.degrees(lon2) + 540, F.lit(360.0)) - 180).alias("lon"))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """``box``: least and greatest latitude, least and greatest longitude."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def rings(wkt: str) -> list[list[tuple[float, float]]]:
    """The rings, as (lon, lat) points, of a POLYGON or MULTIPOLYGON text."""
    import re

    found = re.findall(r"\(([^()]+)\)", wkt)
    return [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in found]


def inside(lat: Column, lon: Column, shape: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Whether a point lies within the rings (holes are rings too), not on an edge, by counting the edges that a ray crosses: an expression, no function call for each row."""
    crossings, edge = F.lit(0), F.lit(False)
    for ring in shape:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            along = lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))
            edge = edge | (along & ((lat - y1) * (x2 - x1) == (lon - x1) * (y2 - y1)))
            if y1 != y2:
                hit = ((lat < y1) != (lat < y2)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
                crossings = crossings + hit.cast("int")
    return (crossings % 2 == 1) & ~edge


def degrees_to_edge(lat: Column, lon: Column, shape: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Planar distance in degrees to the nearest edge."""
    found = []
    for ring in shape:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            dx, dy = x2 - x1, y2 - y1
            n = dx * dx + dy * dy
            if n:
                t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - x1) * dx + (lat - y1) * dy) / n))
                found.append(F.sqrt(F.pow(lon - x1 - t * dx, F.lit(2)) + F.pow(lat - y1 - t * dy, F.lit(2))))
    return F.least(*found) if len(found) > 1 else found[0]


def within_radius(points: DataFrame, lat: str, lon: str, centre: tuple[float, float], km: float) -> DataFrame:
    """Rows within ``km`` of a point, with ``distance``; a box is tried first, so the filter can reach the scan."""
    span = km / KM_PER_DEGREE * 1.01
    distance = haversine(F.col(lat), F.col(lon), F.lit(centre[0]), F.lit(centre[1]))
    return points.where(F.col(lat).between(centre[0] - span, centre[0] + span)).withColumn("distance", distance).where(F.col("distance") <= km)


def nearest(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, lat: str, lon: str, km: float, k: int = 1) -> DataFrame:
    """``query_id, point_id, distance, place`` of the ``k`` nearest points within ``km``: both sides are dealt in grid cells as wide as the radius, and a query meets the points of
    its own and the neighbouring cells by an equi-join. Columns wrap at 180 degrees; a row of cells from which the radius reaches a pole is one cell. Locations meet once, however
    many rows share them: of a location's points only the ``k`` of least id can be among the nearest. Points beyond ``km`` aren't found."""
    span = km / KM_PER_DEGREE
    left = queries.select(F.col(query_id).alias("q"), F.col(lat).alias("y1"), F.col(lon).alias("x1")).where("y1 is not null and x1 is not null")
    right = points.select(F.col(point_id).alias("p"), F.col(lat).alias("y2"), F.col(lon).alias("x2")).where("y2 is not null and x2 is not null")
    right = right.withColumn("n", F.row_number().over(Window.partitionBy("y2", "x2").orderBy("p"))).where(F.col("n") <= k)

    def columns(row: Column) -> Column:
        """How many columns a row has, each as wide at least as the difference of longitude that the radius spans at the row's end by the pole."""
        end = F.greatest(F.abs(row), F.abs(row + 1)) * span
        widest = F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(span))) / F.cos(F.radians(end)), F.lit(1.0))))
        return F.when(end + span < 90, F.greatest(F.floor(360 / widest), F.lit(1))).otherwise(F.lit(1)).cast("long")

    def column(x: Column, n: Column) -> Column:
        return F.least(F.floor(F.pmod(x + 180, F.lit(360.0)) * n / 360), n - 1)

    row1, row2 = F.floor(F.col("y1") / span), F.floor(F.col("y2") / span)
    near_rows = left.select("y1", "x1").distinct().withColumn("r", F.explode(F.sequence(row1 - 1, row1 + 1))).withColumn("n", columns(F.col("r"))).withColumn("c", column(F.col("x1"), F.col("n")))
    cells = near_rows.withColumn("c", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("c") + i, F.col("n")) for i in (-1, 0, 1)]))))
    placed = right.withColumn("r", row2).withColumn("c", column(F.col("x2"), columns(row2))).select("p", "y2", "x2", "r", "c")
    met = cells.join(placed, ["r", "c"]).withColumn("distance", haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))).where(F.col("distance") <= km)
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("y1", "x1").orderBy("distance", "p"))).where(F.col("place") <= k)
    return left.join(best.select("y1", "x1", "p", "distance", "place"), ["y1", "x1"]).select(F.col("q").alias(query_id), F.col("p").alias(point_id), "distance", "place")


def pairwise_distances(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, lat: str, lon: str, unit: str = "km") -> DataFrame:
    """``query_id, point_id, distance`` of each of a stated set of queries with all points, null where a coordinate is missing. As many rows as both tables' numbers multiplied:
    meant for few queries. The points are dealt to all cores, since a few MB of them make many rows."""
    session = points.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    left = queries.select(F.col(query_id).alias("q"), F.col(lat).alias("y1"), F.col(lon).alias("x1"))
    right = points.select(F.col(point_id).alias("p"), F.col(lat).alias("y2"), F.col(lon).alias("x2")).repartition(tasks)
    distance = F.when(F.expr("y1 is not null and x1 is not null and y2 is not null and x2 is not null"), haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"), unit))
    return right.join(left, how="cross").select(F.col("q").alias(query_id), F.col("p").alias(point_id), distance.alias("distance"))


def distance_summary(queries: DataFrame, points: DataFrame, query_id: str, lat: str, lon: str, unit: str = "km") -> DataFrame:
    """``query_id, n, mean, farthest``: how many points each of a stated set of queries has, and the mean and the largest of their distances. Locations meet once, however many rows
    share them, and count as often: the work is the number of the queries' different locations times that of the points'. Pairs without coordinates are in ``n`` only."""
    asked = queries.select(F.col(query_id).alias("q"), F.struct(F.col(lat).alias("y"), F.col(lon).alias("x")).alias("at")).groupBy("q", "at").agg(F.count("*").alias("times"))
    sites = asked.select("at").distinct().select("at", "at.y", "at.x")
    places = points.select(F.col(lat).alias("y"), F.col(lon).alias("x")).groupBy("y", "x").agg(F.count("*").alias("n"))
    met, n, d = pairwise_distances(sites, places, "at", "n", "y", "x", unit), F.col("n"), F.col("distance")
    of_site = met.groupBy("at").agg(F.sum(n).alias("n"), F.sum(F.when(d.isNotNull(), n)).alias("known"), F.sum(d * n).alias("total"), F.max(d).alias("farthest"))
    times = F.col("times")
    found = asked.join(of_site, "at").groupBy("q").agg(F.sum(times * n).alias("n"), (F.sum(times * F.col("total")) / F.sum(times * F.col("known"))).alias("mean"), F.max("farthest").alias("farthest"))
    return found.withColumnRenamed("q", query_id)


def k_nearest(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, lat: str, lon: str, k: int = 1, first_km: float = 50.0) -> DataFrame:
    """``query_id, point_id, distance, place`` of the ``k`` nearest points, however far. `nearest` is asked with a radius; queries that find fewer than ``k`` points go on with four
    times that, until all have them or the radius is half the earth's circumference. Queries without coordinates have no rows."""
    half = math.pi * EARTH_KM
    open_, km, found = cut(queries.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(query_id, lat, lon)), first_km, []
    while True:
        near = cut(nearest(open_, points, query_id, point_id, lat, lon, min(km, half * 1.001), k))
        whole = near.groupBy(query_id).count().where(F.col("count") >= k).select(query_id) if km < half else near.select(query_id).distinct()
        found.append(near.join(whole, query_id, "left_semi"))
        if km >= half:
            break
        open_ = cut(open_.join(whole, query_id, "left_anti"))
        if not open_.take(1):
            break
        km *= 4
    return reduce(DataFrame.unionByName, found)
