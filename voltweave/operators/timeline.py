"""Status logs of stations: cleaning, durations, flags, plug-ins and regular grids.

Every window is by station in time order, so the steps share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULTS, OCCUPIED, STATUSES, Params
from ..sources.readers import local_time


def by_station() -> WindowSpec:
    return Window.partitionBy("station_id").orderBy("ts")


def dedup_status(log: DataFrame) -> DataFrame:
    """Rows where a station's status changes; of rows at one time the last (by event_id) counts."""
    order = Window.partitionBy("station_id").orderBy("ts", "event_id")
    last = log.withColumn("later", F.lead("ts").over(order)).filter("later is null or later <> ts").drop("later")
    return last.withColumn("prev_status", F.lag("status").over(order)).filter(~F.col("status").eqNullSafe(F.col("prev_status")))


def micros_between(start: str, stop: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {stop})")


def state_durations(transitions: DataFrame) -> DataFrame:
    """Adds next_ts and duration_us, the time until the next transition (null for the last)."""
    return transitions.withColumn("next_ts", F.lead("ts").over(by_station())).withColumn("duration_us", micros_between("ts", "next_ts"))


def duration_stats(durations: DataFrame) -> DataFrame:
    """Median and interquartile range of durations by station and status, in seconds."""
    q = F.percentile("duration_us", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    stats = durations.groupBy("station_id", "status").agg(q)
    return stats.select("station_id", "status", (F.col("q")[1] / 1e6).alias("median_s"), ((F.col("q")[2] - F.col("q")[0]) / 1e6).alias("iqr_s"))


def suspicious_flags(durations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds is_suspicious: far longer than usual for the station and status, and than plausible."""
    seconds = F.col("duration_us") / 1e6
    flag = (seconds > F.col("median_s") + params.iqr_multiplier * F.col("iqr_s")) & (seconds > params.max_plausible_hours * 3600)
    return durations.join(duration_stats(durations), ["station_id", "status"]).withColumn("is_suspicious", F.coalesce(flag, F.lit(False))).drop("median_s", "iqr_s")


def plugin_events(flagged: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Changes to Occupied from anything else (a log's first row counts) that aren't suspicious."""
    before = F.lag("status").over(by_station())
    changed = flagged.withColumn("before", before).filter((F.col("status") == OCCUPIED) & ~F.col("before").eqNullSafe(F.lit(OCCUPIED)))
    return changed.filter(~F.col("is_suspicious")).select("station_id", "site_id", "ts", local_time(F.col("ts"), params.zone).alias("local_ts"))


def plugins_by_hour(plugins: DataFrame) -> DataFrame:
    return plugins.groupBy("site_id", F.hour("local_ts").alias("hour")).agg(F.count(F.lit(1)).alias("plugins"))


def slot(ts: str, minutes: int) -> Column:
    """Number of the first grid point at or after a time."""
    size = minutes * 60_000_000
    return F.expr(f"(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) + {size - 1}) div {size}")


def slot_time(slot_: Column, minutes: int) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), slot_ * minutes)


def grid_intervals(transitions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """For each transition the grid slots [first, last] on which its status is the station's latest.

    A station is on the grid from the slot at or after its first row to the slot at or after its last.
    """
    m = params.resample_minutes
    here = slot("ts", m)
    upto = F.coalesce(slot("next_ts", m) - 1, here)
    return transitions.withColumn("next_ts", F.lead("ts").over(by_station())).select(*transitions.columns, here.alias("first_slot"), upto.alias("last_slot")).filter("first_slot <= last_slot")


def resample_status(transitions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row for each station and grid point."""
    spread = grid_intervals(transitions, params).withColumn("slot", F.explode(F.sequence("first_slot", "last_slot")))
    return spread.select("station_id", "site_id", slot_time(F.col("slot"), params.resample_minutes).alias("grid_ts"), "status")


def asof_last(left: DataFrame, right: DataFrame, by: str, time: str, *values: str, strict: bool = False) -> DataFrame:
    """``left`` with the values of the last row of ``right`` (same ``by``) at or before its time; before it, if strict.

    One shuffle and one sort of the union, and no join.
    """
    both = left.select("*", F.lit(None).alias("__state"), F.lit(0 if strict else 1).alias("__rank")).unionByName(
        right.select(by, time, F.struct(*values).alias("__state"), F.lit(1 if strict else 0).alias("__rank")), allowMissingColumns=True
    )
    seen = F.last("__state", ignorenulls=True).over(Window.partitionBy(by).orderBy(time, "__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("__seen", seen).filter("__state is null")
    return found.select(*left.columns, *[F.col("__seen")[v].alias(v) for v in values])


def running_reset_sum(df: DataFrame, by: list[str], order: str, amount: str, reset: str, name: str) -> DataFrame:
    """Sum of ``amount`` since the last row with ``reset``, which itself counts 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = df.withColumn("__part", F.sum(F.col(reset).cast("int")).over(w))
    inner = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grouped.withColumn(name, F.sum(F.when(F.col(reset), 0.0).otherwise(F.col(amount))).over(inner)).drop("__part")


def status_number(status: Column) -> Column:
    """0 Available, 0.5 Unavailable, 1 Occupied."""
    return F.when(status == STATUSES[0], 0.0).when(status == STATUSES[2], 0.5).when(status == OCCUPIED, 1.0)


def dead_time_filter(arrivals: DataFrame, d: float, by: str = "charger_id", hour: str = "hour") -> DataFrame:
    """Arrivals that find the charger free: each at least ``d`` hours after the last one kept.

    An arrival at least ``d`` hours after the one before is kept whatever happened
    earlier, so a charger's arrivals fall into stretches of their own there; only
    within a stretch they are folded in order.
    """
    order = Window.partitionBy(by).orderBy(hour)
    apart = F.coalesce(F.col(hour) - F.lag(hour).over(order) >= d, F.lit(True)).cast("int")
    parts = arrivals.select(by, hour).withColumn("__apart", apart).withColumn("__part", F.sum("__apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<double>").alias("kept"))
    step = lambda acc, t: F.when(t >= acc["last"] + d, F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc)
    kept = F.aggregate(F.array_sort(F.collect_list(hour)), start, step, lambda acc: acc["kept"])
    return parts.groupBy(by, "__part").agg(kept.alias("kept")).select(by, F.explode("kept").alias(hour))
