"""One query for each operator, over the logical tables that the driver's tables give."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EV_SHARE, Params
from ..functions import geo, money
from ..operators import demand, gaps, graph, model, simulation, site, spatial, timeline
from ..sources import readers
from ..sources.fixtures import Fixtures, position
from ..streaming import status as streaming
from .staging import shared_dir, stage

#: The test log is sparse: an hour instead of five minutes, so that some plug-ins are queued.
PARAMS = Params(queue_minutes=60.0)
#: Hours of a charge, for the dead-time queries.
DEAD_HOURS = 3.0


def r6(column: str | Column, name: str | None = None) -> Column:
    name = name or column
    return F.round(column, 6).alias(name)


class Tables:
    """Logical tables and the steps between them, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = PARAMS):
        self.spark, self.params, self.fixtures = spark, params, Fixtures(spark, sf_dir)

    log = cached_property(lambda self: self.fixtures.availabilities())
    transitions = cached_property(lambda self: timeline.dedup_status(self.log))
    durations = cached_property(lambda self: timeline.state_durations(self.transitions))
    flagged = cached_property(lambda self: timeline.suspicious_flags(self.durations, self.params))
    plugins = cached_property(lambda self: timeline.plugin_events(self.flagged, self.params))
    states = cached_property(lambda self: site.site_states(self.flagged, self.params))
    grid = cached_property(lambda self: site.site_grid(self.transitions, self.params))
    percentages = cached_property(lambda self: site.hourly_status_pct(self.grid, self.params))
    days = cached_property(lambda self: site.unique_days(self.states))
    queued = cached_property(lambda self: demand.queued_plugins(self.plugins, self.states, self.params))
    hourly = cached_property(lambda self: demand.hourly_demand(self.plugins, self.queued, self.percentages, self.days, self.params))
    matrix = cached_property(lambda self: site.site_station_matrix(self.flagged))
    stats = cached_property(lambda self: demand.site_stats(self.hourly, self.plugins, self.states, self.params))
    roads = cached_property(lambda self: spatial.road_attributes(self.fixtures.stations(), self.fixtures.nodes(), "station_id", self.params))

    @cached_property
    def areas(self) -> DataFrame:
        areas = self.fixtures.areas().filter(F.col("year") == self.params.year).select("area_id", "population_estimate", "lat", "lon")
        return spatial.nearest_join(self.fixtures.stations().select("station_id", "lat", "lon"), areas, "station_id", "area_id", ties=True)

    @cached_property
    def features(self) -> DataFrame:
        stations = self.fixtures.stations()
        roads = self.roads.select("station_id", "traffic_volume", "free_flow_speed")
        return stations.join(roads, "station_id").join(self.areas.select("station_id", "area_id", "population_estimate"), "station_id", "left")

    rates = cached_property(lambda self: demand.turn_in_rates(self.hourly, self.features, self.params))
    vertices = cached_property(lambda self: self.fixtures.vertices())
    segments = cached_property(lambda self: graph.polyline_segments(self.vertices))

    @cached_property
    def town_nodes(self) -> DataFrame:
        """Hubs as towns, each tied to the nearest node of the connected graph that has an edge."""
        towns = self.fixtures.hubs().select(F.col("hub_id").alias("town_id"), "lat", "lon")
        return graph.attach_towns(towns, self.fixtures.graph_nodes(), self.fixtures.connected_edges())

    @cached_property
    def paths(self) -> DataFrame:
        origins = self.town_nodes.select(F.col("node_id").alias("origin")).distinct()
        return graph.shortest_paths(self.fixtures.connected_edges(), origins, self.params.weight)

    routes = cached_property(lambda self: graph.town_routes(self.paths, self.town_nodes, self.params))

    @cached_property
    def near_chargers(self) -> DataFrame:
        chargers = self.fixtures.stations().select(F.col("station_id").alias("facility_id"), F.col("name").alias("facility_name"), "lat", "lon")
        return spatial.near_facilities(self.fixtures.graph_nodes(), chargers, self.params)

    @cached_property
    def near_hubs(self) -> DataFrame:
        """Every fifth town's place has a charging hub."""
        hubs = self.fixtures.hubs().filter("hub_id % 5 = 0").select(F.col("hub_id").alias("facility_id"), F.col("name").alias("facility_name"), "lat", "lon")
        return spatial.near_facilities(self.fixtures.graph_nodes(), hubs, self.params)

    kept_routes = cached_property(lambda self: stage(self.routes, "town-routes"))
    gap_distances = cached_property(lambda self: gaps.distance_since_facility(self.kept_routes, self.fixtures.graph_nodes(), self.near_chargers))
    hub_distances = cached_property(lambda self: gaps.distance_since_facility(self.kept_routes, self.fixtures.graph_nodes(), self.near_hubs))
    people = cached_property(lambda self: self.fixtures.hubs().select(F.col("hub_id").alias("town_id"), (F.lit(1000) + (F.col("hub_id") * 379) % 9000).alias("population")))
    gaps = cached_property(lambda self: gaps.ranked_gaps(self.gap_distances, self.people, self.params.charger_gap_km))
    hub_gaps = cached_property(lambda self: gaps.ranked_gaps(self.hub_distances, self.people, self.params.hub_gap_km))

    @cached_property
    def training(self) -> DataFrame:
        part = self.fixtures.table("part", "p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
        price = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
        target = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") * 2 + F.col("p_partkey") % 13)
        return part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), price.alias("p_retailprice"), "p_brand", "p_type", F.lit(None).cast("double").alias("nothing"), target.cast("double").alias("target"))

    @cached_property
    def matrix_frame(self) -> DataFrame:
        return model.feature_matrix(self.training, ["p_size", "p_retailprice", "p_brand", "p_type", "nothing"], "target", "p_partkey")

    def arrivals(self) -> DataFrame:
        hour = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3.6e9
        return self.log.filter("status = 'Occupied'").select(F.col("station_id").alias("charger_id"), hour.alias("hour"))


QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


# --- scans and filters ------------------------------------------------------


@query
def towns_over_threshold(t):
    towns = t.fixtures.towns()
    raw = towns.select(F.array(F.struct("name", F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lng"), "population", F.when(F.col("town_id") % 9 == 8, "A").otherwise("P").alias("fcl"))).alias("geonames"))
    return readers.populated_places(raw, t.params.population_threshold).select("name", r6("lat"), r6("lon"), "population")


@query
def active_stations(t):
    return readers.active_stations(t.fixtures.stations(), t.fixtures.sites()).select("station_id", "site_id", "name", r6("lat"), r6("lon"), "kw_rated")


@query
def availability_scan(t):
    got = readers.availability_scan(t.log, t.fixtures.stations(), t.fixtures.sites(), "2024-01-05 00:00:00", "2024-01-25 00:00:00", t.params)
    return got.select("event_id", "station_id", "site_id", "ts", "local_ts", "status")


@query
def island_split(t):
    return t.fixtures.stations().select("station_id", geo.island(F.col("lon"), F.col("lat")).alias("island"))


@query
def all_stations(t):
    stations = t.fixtures.stations().withColumn("island", geo.island(F.col("lon"), F.col("lat")))
    north, south = (stations.filter(F.col("island") == x) for x in ("North", "South"))
    return north.unionByName(south).select("station_id", "site_id", "island", "installation_status")


# --- status series ----------------------------------------------------------


@query
def dedup_status(t):
    return t.transitions.select("station_id", "site_id", "ts", "status", "prev_status")


@query
def state_durations(t):
    return t.durations.select("station_id", "ts", "status", "next_ts", "duration_us")


@query
def status_duration_stats(t):
    return timeline.duration_stats(t.durations).select("station_id", "status", r6("median_s"), r6("iqr_s"))


@query
def suspicious_flags(t):
    return t.flagged.select("station_id", "ts", "status", "is_suspicious")


@query
def plugin_events(t):
    return t.plugins.select("station_id", "site_id", "ts", "local_ts")


@query
def plugins_by_hour(t):
    return timeline.plugins_by_hour(t.plugins)


@query
def resample_status(t):
    return timeline.resample_status(t.transitions, t.params)


@query
def status_steps(t):
    return t.flagged.select("station_id", "ts", timeline.status_number(F.col("status")).alias("level"), "is_suspicious")


# --- sites ------------------------------------------------------------------


@query
def site_station_matrix(t):
    return t.matrix


@query
def site_status(t):
    return t.states.select("site_id", "ts", "local_ts", "status", "is_suspicious")


@query
def site_status_null_as_occupied(t):
    return site.site_states(t.flagged, t.params, null_as_occupied=True).select("site_id", "ts", "status")


@query
def site_status_counts(t):
    return site.status_counts(t.matrix)


@query
def site_grid_status(t):
    return t.grid.groupBy("site_id", "status").agg(F.sum(F.col("next_slot") - F.col("first_slot")).alias("points"))


@query
def hourly_status_pct(t):
    return t.percentages.select("site_id", "hour", *[r6(c) for c in ("pct_available", "pct_occupied", "pct_unavailable")])


@query
def unique_days(t):
    return t.days


@query
def median_occupied(t):
    return site.median_occupied(t.states).select("site_id", r6("median_occupied_s"))


@query
def median_occupied_spell(t):
    return site.median_occupied(t.states, spell=True).select("site_id", r6("median_occupied_s"))


@query
def plot_eligible_sites(t):
    return site.plot_eligible_sites(t.flagged, t.params)


# --- demand -----------------------------------------------------------------


@query
def queued_plugins(t):
    return t.queued.select("station_id", "site_id", "ts")


@query
def hourly_demand(t):
    return t.hourly.select("site_id", "hour", "days", r6("a"), "o", "q_count", "free_arrivals", *[r6(c) for c in ("true_arrivals", "missed", "q", "free_rate", "m", "r")])


@query
def hourly_plot_state(t):
    return demand.plot_state(t.hourly)


@query
def peak_hours(t):
    return demand.peak_hours(t.hourly, t.params)


@query
def site_stats(t):
    s = t.stats
    return s.select("site_id", "stations_with_plugins", *[r6(c) for c in ("daily_charges", "daily_queued", "daily_missed", "median_occupied_s")], "peak", "evs_supported", "national_benefit", "missed_cost", F.round("queue_cost", 4).alias("queue_cost"))


@query
def site_stats_display(t):
    shown = demand.present_stats(t.stats)
    return shown.select("site_id", "charge_time", "peak", "evs_supported", "national_benefit", "daily_charges", "daily_queued", "daily_missed", "missed_cost", "queue_cost")


@query
def turn_in_rates(t):
    return t.rates.select("station_id", "site_id", *[r6(c) for c in ("avg_misses_per_day", "avg_plugins_per_day", "daily_demand", "turnin_rate", "ev_turnin_rate")], "o_total", "days_observed", "traffic_volume")


@query
def demand_strata(t):
    return demand.demand_strata(t.rates).groupBy("stratum").agg(F.count(F.lit(1)).alias("stations"), r6(F.avg("ev_turnin_rate"), "mean_rate"))


@query
def turnin_summary(t):
    got = demand.describe(demand.demand_strata(t.rates), "ev_turnin_rate", "stratum")
    return got.select("stratum", "n", *[r6(c) for c in ("mean", "std", "low", "q25", "q50", "q75", "high")])


@query
def turnin_histogram(t):
    return demand.histogram(demand.demand_strata(t.rates), "ev_turnin_rate", 0.0, 1.0, 20, "stratum")


@query
def correction_formulas(t):
    h = t.hourly.select("site_id", "hour", (F.col("o") / F.col("days")).alias("observed"), (F.col("q_count") / F.col("days")).alias("queued"), (1 - F.col("a")).alias("busy"))
    true, lost = money.corrected_rate(F.col("observed"), F.lit(0.5))
    n, rate, missed = money.rate_from_availability(F.col("observed"), F.col("queued"), F.col("busy"))
    return h.select("site_id", "hour", r6(true, "dead_time_rate"), r6(lost, "dead_time_lost"), r6(n, "joined"), r6(rate, "rate"), r6(missed, "lost"))


@query
def station_markers(t):
    per_site = t.stats.select("site_id", "daily_charges", "daily_missed")
    got = t.fixtures.stations().join(per_site, "site_id", "left")
    events, missed = F.coalesce("daily_charges", F.lit(0.0)), F.coalesce("daily_missed", F.lit(0.0))
    return got.select("station_id", r6(money.circle_radius(events), "radius"), r6(money.missed_shade(missed), "shade"), money.tooltip(F.col("name"), {"Power": F.col("kw_rated").cast("int"), "Status": F.col("installation_status")}).alias("tooltip"))


# --- space ------------------------------------------------------------------


@query
def near_facility_nodes(t):
    chargers = t.fixtures.stations().select(F.col("station_id").alias("facility_id"), F.col("name").alias("facility_name"), "lat", "lon")
    return spatial.near_facilities(t.fixtures.nodes(), chargers, t.params)


@query
def nearest_node(t):
    nodes = t.fixtures.nodes()
    found = graph.attach_towns(t.fixtures.towns(), nodes, t.fixtures.sparse_edges())
    return found.select("town_id", "node_id", r6("distance_km"))


@query
def town_graph(t):
    """The connected graph with its towns and their links."""
    towns = t.fixtures.hubs().select(F.col("hub_id").alias("town_id"), "lat", "lon")
    nodes, edges = graph.with_towns(t.fixtures.graph_nodes(), t.fixtures.connected_edges(), towns, t.town_nodes, t.params)
    ends = graph.both_ways(edges).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("time").alias("time"))
    return nodes.join(ends, "node_id").select("node_id", r6("lat"), r6("lon"), "is_town", "degree", r6("time"))


@query
def nearest_area(t):
    return t.areas.select("station_id", "area_id", "population_estimate", r6("distance_km"))


@query
def nearby_road_attributes(t):
    return t.roads


@query
def neighbor_stats(t):
    got = spatial.neighbor_stats(t.features, t.params)
    return got.select("station_id", "neighbors", *[r6(c) for c in ("mean_distance_km", "mean_population_estimate", "mean_traffic_volume", "mean_free_flow_speed")])


@query
def projected_nodes(t):
    nodes = t.fixtures.nodes()
    east, north = geo.project(F.col("lat"), F.col("lon"), 2193)
    placed = nodes.select("node_id", "lat", "lon", east.alias("east"), north.alias("north"))
    lat, lon = geo.unproject(F.col("east"), F.col("north"), 2193)
    return placed.select("node_id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


# --- graph ------------------------------------------------------------------


@query
def polyline_segments(t):
    return t.segments.select("road_id", "seq", "a", "b", r6("length"), r6("time"))


@query
def road_graph(t):
    return graph.road_graph(t.segments).select("src", "dst", r6("length"), r6("time"))


@query
def road_nodes(t):
    return graph.graph_nodes(t.vertices).select("node_id", r6("lat"), r6("lon"), "free_flow_speed", "traffic_volume")


@query
def node_degree(t):
    return graph.node_degree(graph.road_graph(t.segments))


@query
def contract_graph(t):
    got = graph.contract_graph(t.fixtures.block_edges(), Params(contract_km=1500.0))
    return got.select("src", "dst", r6("length"), r6("time"))


@query
def connected_components(t):
    return graph.connected_components(t.fixtures.graph_nodes(), t.fixtures.block_edges())


@query
def component_closest_pair(t):
    nodes = t.fixtures.graph_nodes()
    found = graph.component_closest_pair(nodes, graph.connected_components(nodes, t.fixtures.block_edges()))
    return found.select("src", "dst", r6("distance_km"))


@query
def patch_components(t):
    return graph.patch_components(t.fixtures.graph_nodes(), t.fixtures.block_edges(), t.params).select("src", "dst", r6("length"), r6("time"))


@query
def stitch_edges(t):
    nodes = t.fixtures.nodes()
    existing = nodes.select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    return graph.stitch_edges(nodes, existing, t.params).select("src", "dst", r6("length"), r6("time"))


@query
def shortest_paths(t):
    return t.paths.select("origin", "node_id", r6("cost"), "pred")


@query
def town_routes(t):
    return t.routes.select("origin", "dest", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), r6("road_cost"), r6("cost"))


@query
def route_geometry(t):
    got = graph.route_geometry(t.routes, t.fixtures.graph_nodes())
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    return got.select("origin", "dest", F.size("line").alias("points"), r6(first[0], "first_lon"), r6(first[1], "first_lat"), r6(last[0], "last_lon"), r6(last[1], "last_lat"))


# --- gaps -------------------------------------------------------------------


@query
def distance_since_facility(t):
    return t.gap_distances.select("origin", "dest", "seq", "node_id", r6("distance_km"), "facility_name")


@query
def ranked_gaps(t):
    return t.gaps.select("node_id", "origin", "dest", r6("distance_km"), "facility_name", "origin_population", "dest_population")


@query
def gap_routes(t):
    return gaps.gap_routes(t.gaps)


@query
def hub_gaps(t):
    return t.hub_gaps.select("node_id", "origin", "dest", r6("distance_km"), "facility_name", "origin_population", "dest_population")


@query
def hub_gap_routes(t):
    return gaps.gap_routes(t.hub_gaps)


# --- prediction -------------------------------------------------------------


@query
def feature_matrix(t):
    return t.matrix_frame.select("p_partkey", "p_size", r6("p_retailprice"), "p_brand", "p_type", "target")


@query
def standardised_features(t):
    got = model.standardised(t.matrix_frame, ["p_size", "p_retailprice"])
    return got.select("p_partkey", (F.round("p_size", 6) + F.lit(0.0)).alias("p_size"), (F.round("p_retailprice", 6) + F.lit(0.0)).alias("p_retailprice"), model.held_out(F.col("p_partkey")).alias("held_out"))


@query
def prediction_metrics(t):
    fixed = t.matrix_frame.withColumn("prediction", F.col("p_size") * 1.9 + 7.5)
    got = model.prediction_metrics(fixed, "target")
    return got.select("n", r6("r"), r6("r2"))


def _tested(t, fit) -> DataFrame:
    """n, r, R2 on held-out rows and the alpha of a model; features are learned from the training rows alone."""
    test = model.held_out(F.col("p_partkey"))
    train = stage(t.training.filter(~test), "train")
    features = model.Features.fit(train, ["p_size", "p_retailprice", "p_brand", "p_type", "nothing"], "target", "p_partkey")
    got = fit(stage(features.transform(train), "train-features"), features.columns)
    return model.prediction_metrics(got.predict(features.transform(t.training.filter(test))), "target").select("n", "r", "r2", F.lit(got.alpha).alias("alpha"))


@query
def ridge_metrics(t):
    return _tested(t, lambda train, columns: model.ridge_cv(train, columns, "target", "p_partkey"))


@query
def lasso_metrics(t):
    return _tested(t, lambda train, columns: model.elastic_net_cv(train, columns, "target", "p_partkey"))


@query
def elastic_net_metrics(t):
    return _tested(t, lambda train, columns: model.elastic_net_cv(train, columns, "target", "p_partkey", l1_ratio=0.5))


@query
def top_predictors(t):
    columns = ["p_size", "p_retailprice", "p_brand", "p_type"]
    fit = model.ridge_cv(model.standardised(t.matrix_frame, columns), columns, "target", "p_partkey")
    return model.top_predictors(t.spark, fit)


@query
def stratified_metrics(t):
    """Regression of demand by destination chargers, journey chargers and all."""
    data = t.rates.filter("ev_turnin_rate <= 1").select("station_id", "kw_rated", "traffic_volume", "free_flow_speed", "population_estimate", "installation_status", "daily_demand")
    strata = {"destination": F.col("kw_rated") < 50, "journey": F.col("kw_rated") >= 50, "all": F.lit(True)}
    rows = model.stratified(stage(data, "strata"), strata, ["kw_rated", "traffic_volume", "free_flow_speed", "population_estimate", "installation_status"], "daily_demand", "station_id")
    return t.spark.createDataFrame(rows, "stratum string, n long, r double, r2 double")


# --- simulated demand -------------------------------------------------------


@query
def dead_time_filter(t):
    got = timeline.dead_time_filter(t.arrivals(), DEAD_HOURS)
    return got.select("charger_id", r6("hour"))


@query
def collisions_per_day(t):
    got = simulation.collisions_per_day(t.arrivals(), 30, DEAD_HOURS)
    return got.select("charger_id", *[r6(c) for c in ("arrivals_per_day", "plugins_per_day", "blocked_per_day")])


@query
def intensity_grid(t):
    steps = t.spark.range(240).select((F.col("id") / 10).alias("hour"))
    rate = money.intensity(F.col("hour"), simulation.RATE)
    return steps.select("hour", r6(rate, "rate"), r6(money.dead_time_factor(rate, DEAD_HOURS), "factor"), r6(money.dead_time_factor_exact(F.col("hour"), DEAD_HOURS, simulation.RATE), "factor_exact"))


@query
def simulate_arrivals(t):
    return simulation.simulate_arrivals(t.spark).select("charger_id", r6("hour"))


@query
def fit_intensity(t):
    kept = timeline.dead_time_filter(simulation.simulate_arrivals(t.spark), DEAD_HOURS)
    plain, scaled = simulation.two_stage_fit(kept, simulation.DAYS)
    return t.spark.createDataFrame([(i, a, b, c) for i, (a, b, c) in enumerate(zip(simulation.RATE, plain, scaled))], "term int, true_weight double, plain double, rescaled double")


@query
def collision_estimate(t):
    """True and modelled arrivals, plug-ins and blocked arrivals a day."""
    arrivals = simulation.simulate_arrivals(t.spark)
    _, scaled = simulation.two_stage_fit(timeline.dead_time_filter(arrivals, DEAD_HOURS), simulation.DAYS)
    modelled = simulation.simulate_arrivals(t.spark, scaled, 10 * simulation.DAYS, seed=11)
    truth = simulation.collisions_per_day(arrivals, simulation.DAYS).withColumn("kind", F.lit("true"))
    return truth.unionByName(simulation.collisions_per_day(modelled, 10 * simulation.DAYS).withColumn("kind", F.lit("modelled"))).drop("charger_id")


@query
def ev_shares(t):
    return t.spark.createDataFrame(list(EV_SHARE.items()), "year int, share double")


# --- streams ----------------------------------------------------------------


def _stream(t) -> DataFrame:
    schema = t.spark.read.parquet(f"{t.fixtures.dir}/events.parquet").schema
    raw = t.spark.readStream.schema(schema).parquet(f"{t.fixtures.dir}/event[s].parquet")
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "purchase"), "Occupied").when(kind == "error", "Unavailable").otherwise("Available")
    return raw.select("event_id", F.col("user_id").alias("station_id"), F.expr("user_id div 3").alias("site_id"), "ts", status.alias("status"))


@query
def streaming_hourly_counts(t):
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex[:12]}"
    return streaming.run_available(streaming.hourly_counts(_stream(t)), t.spark, path, "complete")


@query
def streaming_plugins(t):
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex[:12]}"
    return streaming.run_available(streaming.plugin_stream(_stream(t)), t.spark, path)


__all__ = ["QUERIES", "Tables", "position"]
