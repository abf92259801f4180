"""Latent demand: queued plug-ins, hourly rates, site measures and turn-in rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AVAILABLE, DEFAULTS, Params
from ..functions import money
from . import site, timeline
from .timeline import micros_between


def queued_plugins(plugins: DataFrame, states: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Plug-ins soon after the site became free: of the last two states strictly before, the earlier isn't Available and the later is."""
    order = Window.partitionBy("site_id").orderBy("ts")
    pairs = states.select("site_id", "ts", F.col("ts").alias("free_ts"), F.col("status").alias("last_status"), F.lag("status").over(order).alias("earlier_status"))
    seen = timeline.asof_last(plugins, pairs, "site_id", "ts", "free_ts", "last_status", "earlier_status", strict=True)
    soon = micros_between("free_ts", "ts") <= int(params.queue_minutes * 60_000_000)
    return seen.filter((F.col("last_status") == AVAILABLE) & (F.col("earlier_status") != AVAILABLE) & soon).select(*plugins.columns)


def hourly_demand(plugins: DataFrame, queued: DataFrame, percentages: DataFrame, days: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The 24 hours of each site with observed, queued, missed and true arrivals."""
    spine = days.select("site_id", "days", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    count = lambda df, name: timeline.plugins_by_hour(df).withColumnRenamed("plugins", name)
    joined = spine.join(percentages.select("site_id", "hour", "pct_available"), ["site_id", "hour"], "left").join(count(plugins, "o"), ["site_id", "hour"], "left").join(count(queued, "q_count"), ["site_id", "hour"], "left")
    ever = F.max("pct_available").over(Window.partitionBy("site_id"))
    a = F.when(ever > 0, F.col("pct_available") / 100).otherwise(0.0)
    filled = joined.select("site_id", "hour", "days", a.alias("a"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("q_count", F.lit(0)).alias("q_count"))
    rates = money.rates(F.col("a"), F.col("o"), F.col("q_count"), F.col("days"))
    return filled.select("*", *[v.alias(k) for k, v in rates.items()])


def plot_state(hourly: DataFrame) -> DataFrame:
    """Whether a site's hourly chart has enough in it."""
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    charged = of("q") + of("free_rate")
    state = F.when(F.sum(charged + of("m") + of("r")) == 0, "No data").when((F.max(charged) < 0.1) & (F.max(of("m")) < 0.1), "Insufficient").otherwise("Plot")
    return hourly.groupBy("site_id").agg(state.alias("plot_state"))


def peak_hours(hourly: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """First and last hour whose rate is over the greatest one's share."""
    top = F.max("r").over(Window.partitionBy("site_id"))
    over = hourly.withColumn("over", F.col("r") > top / params.peak_ratio)
    hour = F.when(F.col("over"), F.col("hour"))
    return over.groupBy("site_id").agg(F.min(hour).alias("peak_start"), F.max(hour).alias("peak_stop")).withColumn("peak", money.hours_window(F.col("peak_start"), F.col("peak_stop")))


def site_stats(hourly: DataFrame, plugins: DataFrame, states: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The measures of each site, as numbers.

    Daily sums are rounded to nine places, so that costs, which are cut to whole
    dollars, do not depend on the order of summation.
    """
    per_site = hourly.groupBy("site_id").agg((F.sum("o") / F.max("days")).alias("daily_charges"), *[F.round(F.coalesce(F.sum(c), F.lit(0.0)), 9).alias(name) for c, name in (("m", "daily_missed"), ("q", "daily_queued"))])
    active = plugins.groupBy("site_id").agg(F.count_distinct("station_id").alias("active"))
    joined = per_site.join(active, "site_id", "left").join(site.median_occupied(states), "site_id").join(peak_hours(hourly, params).select("site_id", "peak"), "site_id")
    evs = money.evs_supported(F.col("daily_charges"), params)
    return joined.select(
        "site_id",
        F.coalesce("active", F.lit(0)).alias("stations_with_plugins"),
        "daily_charges",
        "daily_queued",
        "daily_missed",
        "median_occupied_s",
        "peak",
        evs.alias("evs_supported"),
        money.national_benefit(evs, params).alias("national_benefit"),
        money.missed_cost(F.col("daily_missed"), params).alias("missed_cost"),
        money.queue_cost(F.col("median_occupied_s"), F.col("daily_queued"), params).alias("queue_cost"),
    )


def present_stats(stats: DataFrame) -> DataFrame:
    """The measures as texts for display."""
    one = lambda c: F.coalesce(F.bround(c, 1), F.lit(0.0))
    return stats.select(
        "site_id",
        "stations_with_plugins",
        one("daily_charges").alias("daily_charges"),
        one("daily_queued").alias("daily_queued"),
        one("daily_missed").alias("daily_missed"),
        money.clock(F.col("median_occupied_s")).alias("charge_time"),
        "peak",
        F.concat(F.lit("~"), F.col("evs_supported").cast("string"), F.lit(" EVs")).alias("evs_supported"),
        money.dollars(F.col("national_benefit")).alias("national_benefit"),
        money.dollars(F.col("missed_cost")).alias("missed_cost"),
        F.when(F.col("queue_cost") == 0, "0").otherwise(money.dollars(F.bround("queue_cost").cast("long"))).alias("queue_cost"),
    )


def turn_in_rates(hourly: DataFrame, stations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Stations with their site's demand against the traffic that passes; the site's demand repeats on each of its stations."""
    per_site = hourly.groupBy("site_id").agg(F.sum("m").alias("avg_misses_per_day"), F.sum("o").alias("o_total"), F.max("days").alias("days_observed"))
    joined = stations.join(per_site, "site_id", "left").withColumn("avg_plugins_per_day", F.try_divide("o_total", "days_observed"))
    joined = joined.withColumn("daily_demand", F.col("avg_plugins_per_day") + F.col("avg_misses_per_day"))
    share = money.ev_share(params.year)
    ev = F.try_divide(F.col("daily_demand"), F.col("traffic_volume") * share) if share is not None else F.lit(None).cast("double")
    return joined.withColumn("turnin_rate", F.try_divide("daily_demand", "traffic_volume")).withColumn("ev_turnin_rate", ev)


def demand_strata(rates: DataFrame) -> DataFrame:
    """Rows of each stratum (destination below 50 kW, journey from 50 kW, all) whose EV turn-in rate is at most 1."""
    fine = rates.filter("ev_turnin_rate <= 1")
    strata = F.array_compact(F.array(F.lit("all"), F.when(F.col("kw_rated") < 50, "destination"), F.when(F.col("kw_rated") >= 50, "journey")))
    return fine.withColumn("stratum", F.explode(strata))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, deviation, quartiles and range of a column."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high"))
    return stats.select(*by, "n", "mean", "std", "low", *[F.col("q")[k].alias(f"q{25 * (k + 1)}") for k in range(3)], "high")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """Rows in each of ``bins`` equal bins over [low, high]; the last is closed."""
    width = (high - low) / bins
    number = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    return df.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*by, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
