"""Joins by distance: grid cells make them equi-joins, an exact distance decides.

The Earth is cut into bands of latitude a radius high, each band into cells that are
at least a radius wide anywhere in it and in its neighbours, so two points within
the radius are in the same or adjacent cells of the left one's band; the points of
the right side are repeated over three bands and three cells of each.  No pass over
the data is needed beforehand.  Longitudes must not cross the antimeridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.geo import DEGREE_KM, haversine
from ..plans.staging import stage

#: Half of the Earth's circumference: no two points are farther apart.
FARTHEST_KM = math.pi * 6371.0088


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height)


def _cell(lon: Column, band: Column, height: float) -> Column:
    """Number of the cell of a band in which a longitude lies."""
    low = band * height - 90
    highest = F.least(F.lit(89.9), F.greatest(F.abs(low), F.abs(low + height)) + height)
    return F.floor((lon + 180) / F.least(F.lit(360.0), F.lit(height) / F.cos(F.radians(highest))))


def radius_join(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of rows within a radius, with ``distance_km``.

    Both sides need lat and lon and must share no other column name; the right
    side's come out as right_lat and right_lon.  The right side is the one repeated.
    """
    height = min(180.0, radius_km / DEGREE_KM * 1.000001)
    near = F.array(*map(F.lit, (-1, 0, 1)))
    spread = right.withColumn("__cy", F.explode(F.transform(near, lambda d: _band(right["lat"], height) + d)))
    spread = spread.withColumn("__cx", F.explode(F.transform(near, lambda d: _cell(F.col("lon"), F.col("__cy"), height) + d))).withColumnsRenamed({"lat": "right_lat", "lon": "right_lon"})
    here = left.withColumn("__cy", _band(left["lat"], height))
    pairs = here.withColumn("__cx", _cell(F.col("lon"), F.col("__cy"), height)).join(spread, ["__cy", "__cx"]).drop("__cy", "__cx")
    return pairs.withColumn("distance_km", haversine(F.col("lat"), F.col("lon"), F.col("right_lat"), F.col("right_lon"))).filter(F.col("distance_km") <= radius_km)


def self_radius_candidates(points: DataFrame, other: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of rows of one table, each unordered pair once, among them all within a radius; the caller decides by the distance.

    ``points``: node_id, lat, lon and more; ``other``: right_id, lat, lon of the same rows, the
    last two come out as right_lat and right_lon.  A row meets those of its own cell (there the
    smaller id comes first), of the next cell of its band and of three cells of the band above.
    Spark's sizes don't count the copies, so these are never broadcast, whatever the threshold.
    """
    height = min(180.0, radius_km / DEGREE_KM * 1.000001)
    steps = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    spread = other.withColumn("__s", F.explode(steps)).withColumn("__cy", _band(F.col("lat"), height) - F.col("__s.y"))
    spread = spread.withColumn("__cx", _cell(F.col("lon"), F.col("__cy"), height) - F.col("__s.x")).withColumn("__own", (F.col("__s.y") == 0) & (F.col("__s.x") == 0))
    spread = spread.drop("__s").withColumnsRenamed({"lat": "right_lat", "lon": "right_lon"})
    here = points.withColumn("__cy", _band(F.col("lat"), height))
    pairs = here.withColumn("__cx", _cell(F.col("lon"), F.col("__cy"), height)).join(spread.hint("merge"), ["__cy", "__cx"])
    return pairs.filter("if(__own, node_id < right_id, node_id <> right_id)").drop("__cy", "__cx", "__own")


def usual_spacing(points: DataFrame) -> float:
    """Radius in km of a circle that would hold about four of the points, were they spread evenly over their bounds."""
    n, low, high, west, east = points.agg(F.count(F.lit(1)), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if not n or low is None or west is None:
        return FARTHEST_KM
    area = max(1e-6, (high - low) * (east - west) * math.cos(math.radians((low + high) / 2))) * DEGREE_KM**2
    return min(FARTHEST_KM, max(0.1, math.sqrt(4 * area / n / math.pi)))


def nearest_join(left: DataFrame, right: DataFrame, key: str, order: str, ties: bool = False, start_km: float | None = None) -> DataFrame:
    """Each row of ``left`` (unique ``key``) with its nearest of ``right``; of equals the first by ``order``, or all if ties.

    Radius joins with a growing radius, each over the rows that found nothing so far.
    The first radius follows from how dense the right side is, unless given.
    """
    right = stage(right, "near-right")
    found, rest, radius = None, stage(left, "near-left"), start_km or usual_spacing(right)
    while True:
        near = radius_join(rest, right, radius)
        if ties:
            least = near.groupBy(key).agg(F.min("distance_km").alias("__least"))
            got = near.join(least, key).filter("distance_km = __least").drop("__least")
        else:
            columns = [c for c in near.columns if c != key]
            best = near.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("distance_km", order)).alias("__best"))
            got = best.select(key, "__best.*")
        got = stage(got, "nearest")
        found = got if found is None else found.unionByName(got)
        if radius >= FARTHEST_KM:
            return found
        rest = stage(rest.join(got.select(key).distinct(), key, "left_anti"), "farther")
        if rest.isEmpty():
            return found
        radius = min(FARTHEST_KM, radius * 4)


def named_once(facilities: DataFrame) -> DataFrame:
    """Facilities (facility_id, facility_name, lat, lon) with one row for each name: the first's id, the last's place."""
    last = F.max_by(F.struct("lat", "lon"), "facility_id").alias("at")
    nameless = F.when(F.col("facility_name").isNull(), F.col("facility_id")).alias("nameless")
    return facilities.groupBy("facility_name", nameless).agg(F.min("facility_id").alias("facility_id"), last).select("facility_id", "facility_name", "at.lat", "at.lon")


def near_facilities(nodes: DataFrame, facilities: DataFrame, params: Params = DEFAULTS, how: str = "last") -> DataFrame:
    """Nodes within reach of a facility (facility_id, facility_name, lat, lon), with the last in table order or the nearest.  Facilities of one name are one."""
    pairs = radius_join(nodes.select("node_id", "lat", "lon"), named_once(facilities), params.facility_km)
    pick = F.max_by("facility_name", "facility_id") if how == "last" else F.min_by("facility_name", F.struct("distance_km", "facility_id"))
    return pairs.groupBy("node_id").agg(pick.alias("facility_name"), F.count(F.lit(1)).alias("facilities"))


def road_attributes(points: DataFrame, nodes: DataFrame, key: str, params: Params = DEFAULTS) -> DataFrame:
    """The greatest traffic volume (and that node's speed) within reach of each point; with none in reach, the nearest node's.

    ``nodes`` should be those of the road graph that have an edge (graph.connected_nodes).
    """
    valued = nodes.filter("traffic_volume is not null").select("node_id", F.col("lat"), F.col("lon"), "traffic_volume", "free_flow_speed")
    here = stage(points.select(key, "lat", "lon"), "points")
    reach = radius_join(here, valued, params.road_km)
    best = reach.groupBy(key).agg(F.max_by(F.struct("node_id", "traffic_volume", "free_flow_speed"), F.struct(F.col("traffic_volume"), -F.col("node_id"))).alias("b")).select(key, "b.*", F.lit(True).alias("in_reach"))
    best = stage(best, "in-reach")
    rest = here.join(best.select(key), key, "left_anti")
    nearest = nearest_join(rest, valued, key, "node_id").select(key, "node_id", "traffic_volume", "free_flow_speed", F.lit(False).alias("in_reach"))
    return best.unionByName(nearest)


def neighbor_stats(stations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Other stations within reach (not at the very place): their number and means.  Stations without any stay, with null means."""
    values = ("population_estimate", "traffic_volume", "free_flow_speed")
    other = stations.select("lat", "lon", *[F.col(c).alias(f"near_{c}") for c in values])
    pairs = radius_join(stations.select("station_id", "lat", "lon"), other, params.neighbor_km).filter("distance_km > 0")
    means = [F.avg(f"near_{c}").alias(f"mean_{c}") for c in values]
    stats = pairs.groupBy("station_id").agg(F.count(F.lit(1)).alias("neighbors"), F.avg("distance_km").alias("mean_distance_km"), *means)
    return stations.select("station_id").join(stats, "station_id", "left").withColumn("neighbors", F.coalesce("neighbors", F.lit(0)))


def closest_across(nodes: DataFrame, group: str, start_km: float | None = None) -> DataFrame:
    """For each group of nodes (node_id, lat, lon, ``group``) its closest pair with a node of another group.

    Columns: ``group``, src, dst (src < dst), distance_km.  Equal distances go by the smaller pair.
    """
    found, radius = None, start_km or usual_spacing(nodes)
    rest = nodes
    while True:
        other = nodes.select(F.col("node_id").alias("right_id"), "lat", "lon", F.col(group).alias("right_group"))
        pairs = radius_join(rest.select("node_id", "lat", "lon", group), other, radius).filter(F.col(group) != F.col("right_group"))
        pair = F.struct("distance_km", F.least("node_id", "right_id").alias("src"), F.greatest("node_id", "right_id").alias("dst"))
        got = stage(pairs.groupBy(group).agg(F.min(pair).alias("p")).select(group, "p.src", "p.dst", "p.distance_km"), "closest")
        found = got if found is None else found.unionByName(got)
        if radius >= FARTHEST_KM:
            return found
        rest = stage(rest.join(got.select(group), group, "left_anti"), "apart")
        if rest.isEmpty():
            return found
        radius = min(FARTHEST_KM, radius * 4)
