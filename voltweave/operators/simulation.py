"""Simulated arrivals, dead time and the fit of an arrival rate."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import PERIOD, dead_time_factor_exact, intensity
from .timeline import dead_time_filter

# The example rate (per hour), the hours a charge takes, and the days observed.
RATE = [6 / 24, 4 / 24, 1 / 24, -2 / 24, 0.0]
DEAD_HOURS = 3.0
DAYS = 365


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys: the same on every run, partitioning and engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def simulate_arrivals(spark: SparkSession, rate=RATE, days: int = DAYS, seed: int = 7, chargers: int = 1, period: float = PERIOD) -> DataFrame:
    """charger_id, hour of arrivals of a Poisson process with a rate that varies over the day, by thinning.

    Days are independent, so each is drawn on its own: exponential gaps at the
    greatest rate, summed, each kept with the share of the rate at its time.  A day
    gets a number of draws that all but never fails to pass its end; if one does,
    that is an error.
    """
    top = rate[0] + sum(abs(x) + x for x in rate[1:])
    mean = top * period
    most = int(mean + 12 * math.sqrt(mean) + 30)
    days_ = spark.range(chargers * days).select((F.col("id") / days).cast("long").alias("charger_id"), (F.col("id") % days).alias("day"))
    draws = days_.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(most))))
    keys = [F.col(c) for c in ("charger_id", "day", "i")]
    gap = -F.log(uniform(seed, *keys)) / top
    run = Window.partitionBy("charger_id", "day").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = draws.withColumn("t", F.sum(gap).over(run))
    short = F.raise_error(F.lit("a day's draws end before its period"))
    timed = summed.filter(F.when((F.col("i") == most) & (F.col("t") < period), short.isNull()).otherwise(F.col("t") < period))
    kept = timed.filter(uniform(seed + 1, *keys) <= intensity(F.col("t"), rate, period) / top)
    return kept.select("charger_id", (F.col("day") * period + F.col("t")).alias("hour"))


def _basis(t: Column, period: float) -> list[Column]:
    return [intensity(t, [float(k == i) for k in range(5)], period) for i in range(5)]


def fit_intensity(plugins: DataFrame, days: int, weight: Column | None = None, hour: str = "hour", period: float = PERIOD, rounds: int = 60) -> list[float]:
    """Weights of the harmonic rate by maximum likelihood: N T sum(x) - sum(s log rate) at its least.

    Newton steps; each reads the events once for 1 + 5 + 15 sums.  A step is
    halved until the rate is positive over the day and the likelihood rises.
    """
    data = plugins.select(F.col(hour).alias("t"), (weight if weight is not None else F.lit(1.0)).alias("s"))
    basis = _basis(F.col("t"), period)
    grid = np.linspace(0, period, 2000)
    w = 2 * math.pi / period
    shape = np.stack([np.ones_like(grid), 1 + np.sin(w * grid), 1 + np.sin(2 * w * grid), 1 + np.cos(w * grid), 1 + np.cos(2 * w * grid)])

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        rate = intensity(F.col("t"), x.tolist(), period)
        first = [F.sum(F.col("s") * b / rate) for b in basis]
        second = [F.sum(F.col("s") * basis[i] * basis[j] / rate / rate) for i in range(5) for j in range(i, 5)]
        row = data.agg(F.sum(F.col("s") * F.log(rate)), *first, *second).first()
        v = np.array([float(z or 0.0) for z in row])
        hess = np.zeros((5, 5))
        hess[np.triu_indices(5)] = v[6:]
        return days * period * x.sum() - v[0], days * period - v[1:6], hess + np.triu(hess, 1).T

    x = np.array([(data.agg(F.sum("s")).first()[0] or 1.0) / (days * period), 0.0, 0.0, 0.0, 0.0])
    value, slope, curve = evaluate(x)
    for _ in range(rounds):
        step = np.linalg.lstsq(curve + 1e-12 * np.eye(5), slope, rcond=None)[0]
        if abs(slope @ step) < 1e-9:
            break
        size = 1.0
        while size > 1e-8:
            at = np.maximum(x - size * step, -10.0)
            if (at @ shape).min() > 1e-9:
                new = evaluate(at)
                if new[0] <= value:
                    break
            size /= 2
        else:
            break
        x, (value, slope, curve) = at, new
    return x.tolist()


def two_stage_fit(plugins: DataFrame, days: int, d: float = DEAD_HOURS, hour: str = "hour", period: float = PERIOD) -> tuple[list[float], list[float]]:
    """The plain fit, and the fit with each event weighted for the arrivals its dead time hides."""
    first = fit_intensity(plugins, days, hour=hour, period=period)
    factor = F.coalesce(dead_time_factor_exact(F.col(hour), d, first, period), F.lit(1.0))
    return first, fit_intensity(plugins, days, factor, hour, period)


def collisions_per_day(arrivals: DataFrame, days: int, d: float = DEAD_HOURS, by: str = "charger_id", hour: str = "hour") -> DataFrame:
    """Arrivals, plug-ins and arrivals turned away by day and charger."""
    kept = dead_time_filter(arrivals, d, by, hour).groupBy(by).agg(F.count(F.lit(1)).alias("plugins"))
    counts = arrivals.groupBy(by).agg(F.count(F.lit(1)).alias("arrivals")).join(kept, by, "left")
    plugins = F.coalesce("plugins", F.lit(0))
    return counts.select(by, (F.col("arrivals") / days).alias("arrivals_per_day"), (plugins / days).alias("plugins_per_day"), ((F.col("arrivals") - plugins) / days).alias("blocked_per_day"))
