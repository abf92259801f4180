"""Gaps between facilities along routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .timeline import running_reset_sum


def distance_since_facility(routes: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Distance travelled since the last facility along each route.

    A row for each step i -> i+1, under node i with the distance reached at i+1.
    It is 0 if either end is near a facility (node_id, facility_name).  Until one
    is passed the name is the route's origin.
    """
    at = nodes.select("node_id", "lat", "lon").join(near.select("node_id", "facility_name"), "node_id", "left")
    steps = routes.select("origin", "dest", F.posexplode("path").alias("seq", "node_id")).join(at, "node_id")
    order = Window.partitionBy("origin", "dest").orderBy("seq")
    after = {c: F.lead(c).over(order).alias(f"{c}_b") for c in ("lat", "lon", "facility_name", "node_id")}
    pairs = steps.select("*", *after.values()).filter("node_id_b is not null")
    pairs = pairs.withColumn("step_km", haversine(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")))
    pairs = pairs.withColumn("passed", F.coalesce("facility_name", "facility_name_b")).withColumn("near", F.col("passed").isNotNull())
    summed = running_reset_sum(pairs, ["origin", "dest"], "seq", "step_km", "near", "distance_km")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return summed.select("origin", "dest", "seq", "node_id", "distance_km", F.last("passed", ignorenulls=True).over(upto).alias("facility_name"))


def ranked_gaps(distances: DataFrame, populations: DataFrame, threshold_km: float) -> DataFrame:
    """The foremost gap at each node: the longest, then of the larger towns, then the first route."""
    def of(town: str) -> DataFrame:
        return populations.select(F.col("town_id").alias(town), F.col("population").alias(f"{town}_population"))

    long = distances.filter(F.col("distance_km") > threshold_km).join(of("origin"), "origin", "left").join(of("dest"), "dest", "left")
    sizes = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("origin_population", "dest_population")}
    long = long.select("node_id", "origin", "dest", "seq", "distance_km", "facility_name", *sizes.values())
    # A struct of the sort keys makes it one aggregate that combines before the shuffle.
    rank = F.struct(-F.round("distance_km", 9), -F.col("origin_population"), -F.col("dest_population"), "origin", "dest", "seq")
    best = F.min_by(F.struct("distance_km", "facility_name", "origin", "dest", "origin_population", "dest_population"), rank)
    return long.groupBy("node_id").agg(best.alias("g")).select("node_id", "g.*")


def gap_routes(gaps: DataFrame) -> DataFrame:
    return gaps.select("origin", "dest").distinct()
