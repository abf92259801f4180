"""Hand-computed examples of the status series, the sites and the demand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltweave.config import Params
from voltweave.functions import money
from voltweave.operators import demand, site, timeline

LOG = "event_id long, station_id long, site_id long, ts string, status string"
NAMES = {"A": "Available", "O": "Occupied", "U": "Unavailable"}
UTC = Params(zone="UTC")


@pytest.fixture
def log(spark):
    def build(*rows, day="2024-01-05"):
        full = [(i, st, st // 10, f"{day} {hm}:00", NAMES[s]) for i, (st, hm, s) in enumerate(rows)]
        return spark.createDataFrame(full, LOG).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    return build


def hm(ts):
    return ts.strftime("%H:%M")


EXAMPLE = [(1, "08:00", "A"), (1, "08:05", "A"), (1, "08:20", "O"), (1, "08:50", "O"), (1, "09:10", "A")]


def flagged(log, params=UTC):
    return timeline.suspicious_flags(timeline.state_durations(timeline.dedup_status(log)), params)


def test_dedup_durations_plugins(log):
    got = timeline.state_durations(timeline.dedup_status(log(*EXAMPLE))).orderBy("ts").collect()
    assert [(hm(r.ts), r.status[0], r.duration_us and r.duration_us // 60_000_000) for r in got] == [("08:00", "A", 20), ("08:20", "O", 50), ("09:10", "A", None)]
    assert [hm(r.ts) for r in timeline.plugin_events(flagged(log(*EXAMPLE)), UTC).collect()] == ["08:20"]
    assert [hm(r.ts) for r in timeline.plugin_events(flagged(log((1, "07:00", "O"), *EXAMPLE)), UTC).orderBy("ts").collect()] == ["07:00", "08:20"]


def test_last_row_of_a_time_counts(log):
    got = timeline.dedup_status(log((1, "08:00", "A"), (1, "08:00", "O"), (1, "09:00", "A"))).orderBy("ts").collect()
    assert [(hm(r.ts), r.status[0]) for r in got] == [("08:00", "O"), ("09:00", "A")]


def test_resample(log):
    moves = timeline.dedup_status(log(*EXAMPLE))
    got = timeline.resample_status(moves, UTC).orderBy("grid_ts").collect()
    assert [(hm(r.grid_ts), r.status[0]) for r in got] == [("08:00", "A"), ("08:10", "A"), *[(t, "O") for t in ("08:20", "08:30", "08:40", "08:50", "09:00")], ("09:10", "A")]
    pct = {r.hour: r for r in site.hourly_status_pct(site.site_grid(moves, UTC), UTC).collect()}
    assert pct[8].pct_available == pytest.approx(100 / 3) and pct[8].pct_occupied == pytest.approx(200 / 3)
    assert pct[9].pct_available == 50 and pct[9].pct_occupied == 50


def test_a_stretch_between_grid_points_gives_no_row(log):
    got = timeline.resample_status(timeline.dedup_status(log((1, "08:01", "A"), (1, "08:02", "O"), (1, "08:11", "A"))), UTC).orderBy("grid_ts").collect()
    assert [(hm(r.grid_ts), r.status[0]) for r in got] == [("08:10", "O"), ("08:20", "A")]


@pytest.mark.parametrize("a, b, want", [("A", "U", "A"), ("A", "O", "A"), ("U", "U", "U"), ("O", "U", "O"), ("O", "O", "O")])
def test_site_truth_table(log, a, b, want):
    f = flagged(log((11, "08:00", a), (12, "08:00", b)))
    assert [r.status[0] for r in site.site_states(f, UTC).collect()] == [want]
    assert [r.status[0] for r in site.matrix_status(site.site_station_matrix(f)).collect()] == [want]


def test_stations_without_a_state_yet(log):
    f = flagged(log((11, "08:00", "U"), (12, "09:00", "U")))
    assert [r.status[0] for r in site.site_states(f, UTC).orderBy("ts").collect()] == ["U", "U"]
    assert [r.status[0] for r in site.site_states(f, UTC, null_as_occupied=True).orderBy("ts").collect()] == ["O", "U"]


def test_states_equal_those_of_the_matrix(spark):
    import random

    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, st := rng.randrange(9), st // 3, start + dt.timedelta(minutes=rng.randrange(5000)), NAMES[rng.choice("AOU")]) for i in range(500)]
    log = spark.createDataFrame(rows, "event_id long, station_id long, site_id long, ts timestamp_ntz, status string")
    f = flagged(log)
    key = lambda df: sorted((r.site_id, r.ts, r.status, r.is_suspicious) for r in df.collect())
    assert key(site.site_states(f, UTC)) == key(site.matrix_status(site.site_station_matrix(f)))
    moves = timeline.dedup_status(log)
    grid = site.site_grid(moves, UTC).select("site_id", F.explode(F.sequence(F.col("first_slot"), F.col("next_slot") - 1)).alias("slot"), "status")
    dense = timeline.resample_status(moves, UTC).groupBy("site_id", F.col("grid_ts").alias("ts")).agg(F.collect_set("status").alias("s")).collect()
    want = {(r.site_id, r.ts): "Available" if "Available" in r.s else "Unavailable" if set(r.s) == {"Unavailable"} else "Occupied" for r in dense}
    got = {(r.site_id, r.ts): r.status for r in grid.select("site_id", timeline.slot_time(F.col("slot"), 10).alias("ts"), "status").collect()}
    assert got == want
    pct = site.hourly_status_pct(site.site_grid(moves, UTC), UTC).collect()
    assert pct and all(r.pct_available + r.pct_occupied + r.pct_unavailable == pytest.approx(100) for r in pct)


def test_suspicious_needs_both_limits(spark):
    start = dt.datetime(2024, 1, 1)
    hours = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 60, 61]
    rows = [(i, 1, 0, start + dt.timedelta(hours=h), NAMES["AO"[i % 2]]) for i, h in enumerate(hours)]
    log = spark.createDataFrame(rows, "event_id long, station_id long, site_id long, ts timestamp_ntz, status string")
    got = flagged(log).filter("is_suspicious").collect()
    assert [r.ts for r in got] == [start + dt.timedelta(hours=10)]
    assert not flagged(log, Params(max_plausible_hours=100)).filter("is_suspicious").count()


def test_queue_rule(log, spark):
    f = log((1, "00:00", "O"), (1, "00:10", "A"), (1, "00:13", "O"), (1, "00:40", "A"), (1, "01:00", "O"))
    f = flagged(f)
    queued = demand.queued_plugins(timeline.plugin_events(f, UTC), site.site_states(f, UTC), UTC)
    assert [hm(r.ts) for r in queued.collect()] == ["00:13"]


@pytest.mark.parametrize(
    "a, o, q, n, want",
    [(0.5, 10, 2, 5, (8, 16, 6, 0.4, 1.6, 1.2, 3.2)), (0.9, 10, 2, 5, (8, 10, 0, 0.4, 1.6, 0, 2)), (0.0, 3, 1, 5, (2, 3, 0, 0.2, 0.4, 0, 0.6)), (None, 3, 1, 5, (2, None, None, 0.2, 0.4, None, None))],
)
def test_rates(spark, a, o, q, n, want):
    row = spark.createDataFrame([(a, o, q, n)], "a double, o long, q long, n long")
    got = row.select(*money.rates(F.col("a"), F.col("o"), F.col("q"), F.col("n")).values()).first()
    assert [x if x is None else pytest.approx(x) for x in want] == list(got)


def test_peak(spark):
    rows = [(1, h, {7: 1.0, 8: 5.0, 9: 1.9, 17: 2.1}.get(h, 0.0)) for h in range(24)] + [(2, h, 0.0) for h in range(24)]
    got = {r.site_id: r.peak for r in demand.peak_hours(spark.createDataFrame(rows, "site_id long, hour int, r double")).collect()}
    assert got == {1: "08:00-17:00", 2: None}


def test_money(spark):
    one = spark.range(1)
    evs = money.evs_supported(F.lit(6.0))
    got = one.select(evs, money.national_benefit(evs), money.missed_cost(F.lit(0.3)), money.queue_cost(F.lit(2400.0), F.lit(1.5)), money.clock(F.lit(90061.0)), money.clock(F.lit(None).cast("double")), money.dollars(F.lit(1234567)), money.evs_supported(F.lit(0.15))).first()
    assert got[:3] == (100, 1_500_000, 75_000) and got[3] == pytest.approx(7336.5)
    assert got[4:] == ("01:01:01", "N/A", "$1,234,567", 2)  # 2.5 goes to the even number


def test_correction(spark):
    true, lost = money.corrected_rate(F.lit(0.25), F.lit(1.0))
    got = spark.range(1).select(true, lost).first()
    assert got[0] == pytest.approx(1 / 3) and got[1] == pytest.approx(1 / 12)


def test_percentile_and_reset_sum(spark):
    values = spark.createDataFrame([(1, "x", x * 1_000_000) for x in (1, 2, 4, 10)], "station_id long, status string, duration_us long")
    got = timeline.duration_stats(values).first()
    assert (got.median_s, got.iqr_s) == (3.0, 5.5 - 1.75)
    rows = spark.createDataFrame([(1, i, d, n) for i, (d, n) in enumerate([(10.0, False), (20.0, True), (5.0, False), (7.0, False)])], "k int, i int, d double, near boolean")
    assert [r.s for r in timeline.running_reset_sum(rows, ["k"], "i", "d", "near", "s").orderBy("i").collect()] == [10, 0, 5, 12]


def test_dead_time(spark):
    rows = spark.createDataFrame([(1, h) for h in (5.9, 0.0, 6.1, 1.0, 3.0)], "charger_id long, hour double")
    assert sorted(r.hour for r in timeline.dead_time_filter(rows, 3.0).collect()) == [0, 3.0, 6.1]


def test_daylight_saving(spark):
    from voltweave.sources.readers import local_time

    row = spark.createDataFrame([("2023-09-23 14:01:00",)], "t string").select(local_time(F.col("t").cast("timestamp_ntz"), "Pacific/Auckland").alias("l")).first()
    assert row.l == dt.datetime(2023, 9, 24, 3, 1)


def test_asof_strict_or_not(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 5, "c")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 5, 50), (1, 6, 60)], "k int, t int, v int")
    loose = {r.name: r.v for r in timeline.asof_last(left, right, "k", "t", "v").collect()}
    strict = {r.name: r.v for r in timeline.asof_last(left, right, "k", "t", "v", strict=True).collect()}
    assert loose == {"a": 50, "b": 60, "c": None} and strict == {"a": None, "b": 60, "c": None}


def test_strata_and_describe(spark):
    rows = spark.createDataFrame([(1, 25.0, 0.5), (2, 50.0, 0.2), (3, 150.0, 1.5), (4, 50.0, None)], "station_id long, kw_rated double, ev_turnin_rate double")
    got = {r.stratum: r.n for r in demand.describe(demand.demand_strata(rows), "ev_turnin_rate", "stratum").collect()}
    assert got == {"all": 2, "destination": 1, "journey": 1}
    bins = {r.bin: r.n for r in demand.histogram(rows, "ev_turnin_rate", 0.0, 0.5, 5).collect()}
    assert bins == {2: 1, 4: 1}


def test_empty_log(spark, log):
    f = flagged(log((1, "08:00", "A")).filter("false"))
    assert site.site_states(f, UTC).count() == 0 and timeline.plugin_events(f, UTC).count() == 0
    assert site.site_grid(timeline.dedup_status(log((1, "08:00", "A")).filter("false")), UTC).count() == 0
