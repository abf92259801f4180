"""Rates and money measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, EV_SHARE, Params


def rates(a: Column, o: Column, q: Column, n: Column) -> dict[str, Column]:
    """Demand of an hour from the available share a, plug-ins o, queued plug-ins q and days n.

    Nothing is known where a is: greatest() would skip the null.
    """
    free = o - q
    true = F.when(a.isNull(), None).when(a == 0, o.cast("double")).otherwise(F.greatest(F.try_divide(free, a), o.cast("double")))
    missed = true - q - free
    per_day = lambda x: F.try_divide(x, n)
    return {"free_arrivals": free, "true_arrivals": true, "missed": missed, "q": per_day(q), "free_rate": per_day(free), "m": per_day(missed), "r": per_day(q) + per_day(free) + per_day(missed)}


def evs_supported(daily_charges: Column, p: Params = DEFAULTS) -> Column:
    return F.bround(daily_charges / p.public_share / p.charges_per_day).cast("long")


def national_benefit(evs: Column, p: Params = DEFAULTS) -> Column:
    return F.bround(evs * p.benefit).cast("long")


def missed_cost(missed_per_day: Column, p: Params = DEFAULTS) -> Column:
    return (p.benefit * (missed_per_day / p.public_share) * (1 / p.charges_per_day)).cast("long")


def queue_cost(median_seconds: Column, queued_per_day: Column, p: Params = DEFAULTS) -> Column:
    """Yearly cost of waiting half a median charge for each queued car."""
    return median_seconds / 2 / 60 * queued_per_day * p.travel_rate * 365


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a duration, days dropped; N/A if null."""
    s = seconds.cast("long") % 86400
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(seconds.isNull(), "N/A").otherwise(F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60)))


def hours_window(start: Column, stop: Column) -> Column:
    """HH:00-HH:00, null if there is none."""
    two = lambda x: F.concat(F.lpad(x.cast("string"), 2, "0"), F.lit(":00"))
    return F.concat(two(start), F.lit("-"), two(stop))


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def ev_share(year: int) -> float | None:
    return EV_SHARE.get(year)


def frequency_hours(text: str) -> float:
    """Hours of a frequency such as 10T, 2H or D."""
    number, unit = text.rstrip("TMINHDminhd") or "1", text.lstrip("0123456789.").upper()
    scale = {"T": 1 / 60, "MIN": 1 / 60, "H": 1.0, "D": 24.0}
    if unit not in scale:
        raise ValueError(f"no such unit: {text}")
    return float(number) * scale[unit]


def circle_radius(events: Column) -> Column:
    return F.sqrt(25 + 10 * events)


def missed_shade(missed: Column) -> Column:
    """Place on the ramp from green (0) to red (1) over 0 to 2 missed charges."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), missed / 2))


def css_color(r: Column, g: Column, b: Column, a: Column) -> Column:
    part = lambda x: F.bround(x * 255).cast("int").cast("string")
    return F.concat(F.lit("rgba("), F.concat_ws(",", part(r), part(g), part(b), a.cast("string")), F.lit(")"))


def tooltip(name: Column, stats: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("N/A")), F.lit("<br>")) for k, v in stats.items()]
    return F.concat(F.lit("<b>"), name, F.lit(":</b><br>"), *lines)


# --- simulated demand -------------------------------------------------------

PERIOD = 24.0


def intensity(t: Column, x: list[float], period: float = PERIOD) -> Column:
    """Harmonic arrival rate at hour t; its mean over a period is the sum of x."""
    w = 2 * math.pi / period
    return F.lit(float(x[0])) + x[1] * (1 + F.sin(w * t)) + x[2] * (1 + F.sin(2 * w * t)) + x[3] * (1 + F.cos(w * t)) + x[4] * (1 + F.cos(2 * w * t))


def intensity_integral(t: Column, d: float, x: list[float], period: float = PERIOD) -> Column:
    """Integral of the rate over [t - d, t], in closed form."""
    w = 2 * math.pi / period

    def anti(u: Column) -> Column:
        return sum(x) * u - x[1] / w * F.cos(w * u) - x[2] / (2 * w) * F.cos(2 * w * u) + x[3] / w * F.sin(w * u) + x[4] / (2 * w) * F.sin(2 * w * u)

    return anti(t) - anti(t - d)


def dead_time_factor(rate: Column, d: float) -> Column:
    """1 / (1 - d rate), null where the rate can't be told."""
    return F.when(rate * d < 1, 1 / (1 - rate * d))


def dead_time_factor_exact(t: Column, d: float, x: list[float], period: float = PERIOD) -> Column:
    held = intensity_integral(t, d, x, period)
    return F.when(held < 1, 1 / (1 - held))


def corrected_rate(observed: Column, d: Column) -> tuple[Column, Column]:
    """(true rate R = O/(1 - O d), lost rate R - O)."""
    true = F.when(observed * d < 1, observed / (1 - observed * d))
    return true, true - observed


def rate_from_availability(observed: Column, queued: Column, busy: Column) -> tuple[Column, Column, Column]:
    """(N = O - Q, R = N/(1 - f), L = R - N - Q) with f the share of time it is busy."""
    n = observed - queued
    true = F.try_divide(n, 1 - busy)
    return n, true, true - n - queued
