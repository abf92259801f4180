"""Sites: the state of all their stations together.

A site's state changes only where one of its stations does, so states come from
running sums of changes (one row a transition), not from the product of all
times with all stations; that product is a query of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AVAILABLE, DEFAULTS, OCCUPIED, STATUSES, UNAVAILABLE, Params
from ..sources.readers import local_time
from .timeline import by_station, grid_intervals, micros_between, slot_time

COUNTS = ("n_available", "n_occupied", "n_unavailable")


def verdict(null_as_occupied: bool = False, stations: str = "0") -> Column:
    """Available if any station is; Unavailable if all are; else Occupied.

    Stations that have no state yet are left out, or count as neither if null_as_occupied.
    """
    rest = "n_occupied = 0 and n_unavailable > 0" + (f" and n_unavailable = {stations}" if null_as_occupied else "")
    return F.expr(f"case when n_available > 0 then '{AVAILABLE}' when {rest} then '{UNAVAILABLE}' else '{OCCUPIED}' end")


def _changes(df: DataFrame, at: str, status: str, sign: int) -> list[Column]:
    return [F.when(F.col(status) == s, sign).otherwise(0).alias(c) for s, c in zip(STATUSES, COUNTS)]


def site_states(flagged: DataFrame, params: Params = DEFAULTS, null_as_occupied: bool = False) -> DataFrame:
    """State of each site at every time one of its stations changes: site_id, ts, local_ts, status, is_suspicious."""
    w = by_station()
    own = flagged.withColumn("was", F.lag("status").over(w)).withColumn("was_suspicious", F.lag("is_suspicious").over(w))
    change = [(F.when(F.col("status") == s, 1).otherwise(0) - F.when(F.coalesce(F.col("was") == s, F.lit(False)), 1).otherwise(0)).alias(c) for s, c in zip(STATUSES, COUNTS)]
    odd = F.col("is_suspicious").cast("int") - F.coalesce(F.col("was_suspicious").cast("int"), F.lit(0))
    moved = own.select("site_id", "ts", *change, odd.alias("n_suspicious")).groupBy("site_id", "ts").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "n_suspicious")])
    run = Window.partitionBy("site_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stood = moved.select("site_id", "ts", *[F.sum(c).over(run).alias(c) for c in (*COUNTS, "n_suspicious")])
    if null_as_occupied:
        stations = flagged.groupBy("site_id").agg(F.count_distinct("station_id").alias("stations"))
        stood = stood.join(stations, "site_id")
    return stood.select("site_id", "ts", local_time(F.col("ts"), params.zone).alias("local_ts"), verdict(null_as_occupied, "stations").alias("status"), (F.col("n_suspicious") > 0).alias("is_suspicious"))


def site_grid(transitions: DataFrame, params: Params = DEFAULTS, null_as_occupied: bool = False) -> DataFrame:
    """Stretches of grid slots [first_slot, next_slot) of one state: site_id, first_slot, next_slot, status.

    Stations count on the slots where they are on the grid.
    """
    spans = grid_intervals(transitions, params)
    begin = spans.select("site_id", F.col("first_slot").alias("slot"), *_changes(spans, "first_slot", "status", 1))
    end = spans.select("site_id", (F.col("last_slot") + 1).alias("slot"), *_changes(spans, "last_slot", "status", -1))
    moved = begin.unionByName(end).groupBy("site_id", "slot").agg(*[F.sum(c).alias(c) for c in COUNTS])
    order = Window.partitionBy("site_id").orderBy("slot")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stood = moved.select("site_id", F.col("slot").alias("first_slot"), F.lead("slot").over(order).alias("next_slot"), *[F.sum(c).over(run).alias(c) for c in COUNTS])
    if null_as_occupied:
        stood = stood.join(transitions.groupBy("site_id").agg(F.count_distinct("station_id").alias("stations")), "site_id")
    stood = stood.filter("next_slot is not null and n_available + n_occupied + n_unavailable > 0")
    return stood.select("site_id", "first_slot", "next_slot", verdict(null_as_occupied, "stations").alias("status"))


def hourly_status_pct(grid: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Percentage of grid points of each status by site and local hour of day.

    A stretch gives one row for each hour it touches, with its number of points there.
    """
    per_hour = 60 // params.resample_minutes
    if params.resample_minutes * per_hour != 60:
        raise ValueError("the grid must divide the hour")
    hours = grid.withColumn("h", F.explode(F.sequence(F.expr(f"floor(first_slot / {per_hour})"), F.expr(f"floor((next_slot - 1) / {per_hour})"))))
    points = F.least(F.col("next_slot"), (F.col("h") + 1) * per_hour) - F.greatest(F.col("first_slot"), F.col("h") * per_hour)
    hour = F.hour(local_time(slot_time(F.col("h"), 60), params.zone))
    counted = hours.select("site_id", hour.alias("hour"), "status", points.alias("points"))
    total = F.sum("points")
    share = [(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("points"))), F.lit(0)) * 100 / total).alias(f"pct_{s.lower()}") for s in STATUSES]
    return counted.groupBy("site_id", "hour").agg(*share)


def site_station_matrix(flagged: DataFrame) -> DataFrame:
    """Every time of a site with every of its stations, states carried forward."""
    times = flagged.select("site_id", "ts").distinct()
    stations = flagged.select("site_id", "station_id").distinct()
    full = times.join(stations, "site_id").join(flagged.select("station_id", "ts", "status", "is_suspicious"), ["station_id", "ts"], "left")
    carried = by_station().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.select("site_id", "ts", "station_id", *[F.last(c, ignorenulls=True).over(carried).alias(c) for c in ("status", "is_suspicious")])


def matrix_status(matrix: DataFrame) -> DataFrame:
    """Site states from the matrix, by any and all over its stations."""
    known = F.col("status").isNotNull()
    any_free = F.bool_or(F.col("status") == AVAILABLE)
    all_down = F.bool_and(F.when(known, F.col("status") == UNAVAILABLE))
    status = F.when(any_free, AVAILABLE).when(all_down, UNAVAILABLE).otherwise(OCCUPIED)
    return matrix.groupBy("site_id", "ts").agg(status.alias("status"), F.bool_or(F.coalesce("is_suspicious", F.lit(False))).alias("is_suspicious"))


def status_counts(matrix: DataFrame) -> DataFrame:
    """Stations of each status at each time of a site, and their total."""
    counts = matrix.groupBy("site_id", "ts").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(c) for s, c in zip(STATUSES, COUNTS)])
    return counts.withColumn("n_total", sum((F.col(c) for c in COUNTS), F.lit(0)))


def unique_days(states: DataFrame) -> DataFrame:
    """Local dates with a site state, and the calendar days between first and last."""
    day = F.to_date("local_ts")
    return states.groupBy("site_id").agg(F.count_distinct(day).alias("days"), (F.date_diff(F.max(day), F.min(day)) + 1).alias("calendar_days"))


def median_occupied(states: DataFrame, spell: bool = False) -> DataFrame:
    """Median seconds from an Occupied row to the next row, 0 if there is none; of whole spells if ``spell``."""
    order = Window.partitionBy("site_id").orderBy("ts")
    if spell:
        states = states.withColumn("was", F.lag("status").over(order)).filter("not (status <=> was)")
    timed = states.withColumn("next_ts", F.lead("ts").over(order)).withColumn("us", micros_between("ts", "next_ts"))
    middle = F.percentile(F.when(F.col("status") == OCCUPIED, F.col("us")), 0.5)
    return timed.groupBy("site_id").agg(F.coalesce(middle / 1e6, F.lit(0.0)).alias("median_occupied_s"))


def plot_eligible_sites(flagged: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Sites with enough transitions to be drawn."""
    counts = flagged.groupBy("site_id").agg(F.count(F.lit(1)).alias("transitions"))
    return counts.filter(F.col("transitions") >= params.min_transitions)
