"""The queries again as plain SQL over the driver's tables, step by step in named parts.

The SQL takes its own way where it can: site states from the full product of
times and stations, nearest rows from full scans, paths by recursion.
"""

from __future__ import annotations

import math
import re

from ..config import DEFAULTS, EARTH_KM, EV_SHARE, SOUTH_RING
from ..functions import geo
from ..operators.simulation import DAYS, RATE

EV_2023 = EV_SHARE[DEFAULTS.year]


def hav(a: str, b: str) -> str:
    ya, xa, yb, xb = f"radians({a}.lat)", f"radians({a}.lon)", f"radians({b}.lat)", f"radians({b}.lon)"
    s = f"sin(({yb} - {ya}) / 2) * sin(({yb} - {ya}) / 2) + cos({ya}) * cos({yb}) * sin(({xb} - {xa}) / 2) * sin(({xb} - {xa}) / 2)"
    return f"({2 * EARTH_KM}::DOUBLE * asin(sqrt(least(1::DOUBLE, {s}))))"


def pos(k: str, lat=(7919, 0), lon=(104729, 0)) -> str:
    return f"(-46)::DOUBLE + ((({k})::BIGINT * {lat[0]} + {lat[1]}) % 12000)::DOUBLE / 1000::DOUBLE AS lat, 167::DOUBLE + ((({k})::BIGINT * {lon[0]} + {lon[1]}) % 11000)::DOUBLE / 1000::DOUBLE AS lon"


def local(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Pacific/Auckland')"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def in_south(lon: str, lat: str) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(SOUTH_RING, (*SOUTH_RING[1:], SOUTH_RING[0])):
        parts.append(f"(CASE WHEN (({y1}::DOUBLE > {lat}) <> ({y2}::DOUBLE > {lat})) AND {lon} < {x2 - x1!r}::DOUBLE * ({lat} - ({y1}::DOUBLE)) / ({y2 - y1!r}::DOUBLE) + {x1}::DOUBLE THEN 1 ELSE 0 END)")
    return f"(({' + '.join(parts)}) % 2 = 1)"


NODE_KEY = "((round_even(lat * 100000, 0)::BIGINT + 9000000) * 40000000 + (round_even(lon * 100000, 0)::BIGINT + 18000000))"
VERDICT = "CASE WHEN bool_or(status = 'Available') THEN 'Available' WHEN bool_and(status = 'Unavailable') THEN 'Unavailable' ELSE 'Occupied' END"


def near_join(name: str, left: str, right: str, key: str, order: str, columns: str, ties: bool = False) -> str:
    rank = "rank() OVER (PARTITION BY l.{k} ORDER BY {d})" if ties else "row_number() OVER (PARTITION BY l.{k} ORDER BY {d}, r.{o})"
    rank = rank.format(k=key, d=hav("l", "r"), o=order)
    return f"SELECT * FROM (SELECT l.{key}, {columns}, {hav('l', 'r')} AS distance_km, {rank} AS rk FROM {left} l, {right} r) WHERE rk = 1"


PARTS: dict[str, str] = {
    "availabilities": "SELECT event_id, user_id AS station_id, user_id // 3 AS site_id, ts, CASE WHEN event_type IN ('click', 'purchase') THEN 'Occupied' WHEN event_type = 'error' THEN 'Unavailable' ELSE 'Available' END AS status FROM events",
    "stations": f"""SELECT station_id, site_id, 'Station ' || station_id AS name, lat + (station_id % 3)::DOUBLE * 0.05::DOUBLE AS lat, lon,
        CASE station_id % 3 WHEN 0 THEN 25::DOUBLE WHEN 1 THEN 50::DOUBLE ELSE 150::DOUBLE END AS kw_rated,
        CASE WHEN station_id % 11 = 10 THEN 'Planned' ELSE 'Commissioned' END AS installation_status, (station_id % 17 = 16)::INT AS provider_deleted
        FROM (SELECT DISTINCT user_id AS station_id, user_id // 3 AS site_id, {pos("(user_id // 3) * 29", (7907, 4321), (104723, 1234))} FROM events)""",
    "sites": "SELECT DISTINCT user_id // 3 AS site_id, (user_id // 3 % 13 = 12)::INT AS provider_deleted FROM events",
    "nodes": f"SELECT p_partkey AS node_id, {pos('p_partkey')}, (p_size * 200)::DOUBLE AS traffic_volume, (p_size + 50)::DOUBLE AS free_flow_speed FROM part",
    "towns": f"SELECT s_suppkey AS town_id, s_name AS name, {pos('s_suppkey * 13 + 5')}, 1000 + s_suppkey * 379 % 9000 AS population FROM supplier",
    "hubs": f"SELECT n_nationkey::BIGINT AS hub_id, n_name AS name, {pos('n_nationkey * 31 + 7')} FROM nation",
    "areas": f"SELECT n_nationkey::BIGINT AS area_id, {pos('n_nationkey * 17 + 3')}, (1000 + n_nationkey * 111)::DOUBLE AS population_estimate FROM nation",
    "vertices": f"SELECT l_orderkey AS road_id, l_linenumber::BIGINT * 1000000000 + l_partkey AS seq, {pos('l_partkey')}, (50 + l_orderkey % 50)::DOUBLE AS free_flow_speed, (l_orderkey % 97 * 100)::DOUBLE AS traffic_volume FROM lineitem",
    "graph_nodes": f"SELECT s_suppkey AS node_id, {pos('s_suppkey')} FROM supplier",
    "ring": "SELECT s_suppkey AS i, (SELECT count(*) FROM supplier) AS n FROM supplier",
    "connected_pairs": "SELECT i, unnest([(i + 1) % n, (i * 7 + 3) % n]) AS j FROM ring WHERE i % 10 <> 0",
    "block_pairs": "SELECT i, j FROM (SELECT i, n, unnest([i + 1, 5 * (i // 5) + (i * 2 + 1) % 5]) AS j FROM ring WHERE i % 5 <> 4) WHERE j < n",
    # status series
    "latest": "SELECT * FROM availabilities QUALIFY row_number() OVER (PARTITION BY station_id, ts ORDER BY event_id DESC) = 1",
    "transitions": "SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY station_id ORDER BY ts) AS prev_status FROM latest) WHERE status IS DISTINCT FROM prev_status",
    "durations": "SELECT *, lead(ts) OVER (PARTITION BY station_id ORDER BY ts) AS next_ts, epoch_us(lead(ts) OVER (PARTITION BY station_id ORDER BY ts)) - epoch_us(ts) AS duration_us FROM transitions",
    "duration_stats": "SELECT station_id, status, quantile_cont(duration_us::DOUBLE, 0.5) / 1e6 AS median_s, (quantile_cont(duration_us::DOUBLE, 0.75) - quantile_cont(duration_us::DOUBLE, 0.25)) / 1e6 AS iqr_s FROM durations GROUP BY ALL",
    "flagged": "SELECT d.*, coalesce(d.duration_us / 1e6 > s.median_s + 4 * s.iqr_s AND d.duration_us / 1e6 > 86400, false) AS is_suspicious FROM durations d JOIN duration_stats s ON s.station_id = d.station_id AND s.status = d.status",
    "plugins": f"SELECT station_id, site_id, ts, {local('ts')} AS local_ts FROM (SELECT *, lag(status) OVER (PARTITION BY station_id ORDER BY ts) AS before FROM flagged) WHERE status = 'Occupied' AND before IS DISTINCT FROM 'Occupied' AND NOT is_suspicious",
    "slots": "SELECT *, (epoch_us(ts) + 599999999) // 600000000 AS s0, coalesce((epoch_us(next_ts) + 599999999) // 600000000 - 1, (epoch_us(ts) + 599999999) // 600000000) AS s1 FROM durations",
    "resampled": "SELECT station_id, site_id, status, unnest(range(s0, s1 + 1)) AS slot FROM slots WHERE s0 <= s1",
    "grid": f"SELECT site_id, slot, {VERDICT} AS status FROM resampled GROUP BY site_id, slot",
    "percentages": f"""SELECT site_id, hour({local('make_timestamp(slot * 600000000)')})::INT AS hour, count(*) FILTER (status = 'Available') * 100 / count(*) AS pct_available,
        count(*) FILTER (status = 'Occupied') * 100 / count(*) AS pct_occupied, count(*) FILTER (status = 'Unavailable') * 100 / count(*) AS pct_unavailable FROM grid GROUP BY ALL""",
    # sites
    "matrix": """SELECT t.site_id, t.ts, s.station_id, last_value(f.status IGNORE NULLS) OVER w AS status, last_value(f.is_suspicious IGNORE NULLS) OVER w AS is_suspicious
        FROM (SELECT DISTINCT site_id, ts FROM flagged) t JOIN (SELECT DISTINCT site_id, station_id FROM flagged) s USING (site_id) LEFT JOIN flagged f ON f.station_id = s.station_id AND f.ts = t.ts
        WINDOW w AS (PARTITION BY s.station_id ORDER BY t.ts ROWS UNBOUNDED PRECEDING)""",
    "states": f"SELECT site_id, ts, {local('ts')} AS local_ts, {VERDICT} AS status, coalesce(bool_or(is_suspicious), false) AS is_suspicious FROM matrix GROUP BY site_id, ts",
    "days": "SELECT site_id, count(DISTINCT local_ts::DATE) AS days, (max(local_ts::DATE) - min(local_ts::DATE))::INT + 1 AS calendar_days FROM states GROUP BY site_id",
    "medians": "SELECT site_id, coalesce(quantile_cont(us::DOUBLE, 0.5) FILTER (status = 'Occupied') / 1e6, 0::DOUBLE) AS median_occupied_s FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY site_id ORDER BY ts)) - epoch_us(ts) AS us FROM states) GROUP BY site_id",
    "queued": """SELECT p.* FROM plugins p ASOF JOIN (SELECT site_id, ts AS free_ts, status, lag(status) OVER (PARTITION BY site_id ORDER BY ts) AS earlier FROM states) s ON p.site_id = s.site_id AND p.ts > s.free_ts
        WHERE s.status = 'Available' AND s.earlier <> 'Available' AND epoch_us(p.ts) - epoch_us(s.free_ts) <= 3600000000""",
    # demand
    "by_hour": "SELECT site_id, hour(local_ts)::INT AS hour, count(*) AS plugins FROM plugins GROUP BY ALL",
    "queued_by_hour": "SELECT site_id, hour(local_ts)::INT AS hour, count(*) AS plugins FROM queued GROUP BY ALL",
    "filled": """SELECT d.site_id, h.hour::INT AS hour, d.days, CASE WHEN max(p.pct_available) OVER (PARTITION BY d.site_id) > 0 THEN p.pct_available / 100 ELSE 0 END AS a, coalesce(o.plugins, 0) AS o, coalesce(q.plugins, 0) AS q_count
        FROM days d CROSS JOIN range(24) h(hour) LEFT JOIN percentages p ON p.site_id = d.site_id AND p.hour = h.hour LEFT JOIN by_hour o ON o.site_id = d.site_id AND o.hour = h.hour LEFT JOIN queued_by_hour q ON q.site_id = d.site_id AND q.hour = h.hour""",
    "truth": "SELECT *, o - q_count AS free_arrivals, CASE WHEN a IS NULL THEN NULL WHEN a = 0 THEN o::DOUBLE ELSE greatest((o - q_count) / a, o::DOUBLE) END AS true_arrivals FROM filled",
    "hourly": "SELECT *, true_arrivals - q_count - free_arrivals AS missed, q_count / days AS q, free_arrivals / days AS free_rate, (true_arrivals - q_count - free_arrivals) / days AS m, q_count / days + free_arrivals / days + (true_arrivals - q_count - free_arrivals) / days AS r FROM truth",
    "peaks": "SELECT site_id, min(hour) FILTER (r > top / 2.5::DOUBLE) AS peak_start, max(hour) FILTER (r > top / 2.5::DOUBLE) AS peak_stop FROM (SELECT *, max(r) OVER (PARTITION BY site_id) AS top FROM hourly) GROUP BY site_id",
    "peak_names": "SELECT *, lpad(peak_start::VARCHAR, 2, '0') || ':00-' || lpad(peak_stop::VARCHAR, 2, '0') || ':00' AS peak FROM peaks",
    "per_site": "SELECT site_id, sum(o)::BIGINT / max(days) AS daily_charges, round(coalesce(sum(m), 0), 9) AS daily_missed, round(coalesce(sum(q), 0), 9) AS daily_queued FROM hourly GROUP BY site_id",
    "site_stats": """SELECT s.site_id, coalesce(a.active, 0) AS stations_with_plugins, s.daily_charges, s.daily_queued, s.daily_missed, m.median_occupied_s, p.peak,
        round_even(s.daily_charges / 0.15::DOUBLE / 0.4::DOUBLE, 0)::BIGINT AS evs_supported, round_even(round_even(s.daily_charges / 0.15::DOUBLE / 0.4::DOUBLE, 0) * 15000, 0)::BIGINT AS national_benefit,
        trunc(15000::DOUBLE * (s.daily_missed / 0.15::DOUBLE) * (1 / 0.4::DOUBLE))::BIGINT AS missed_cost, m.median_occupied_s / 2 / 60 * s.daily_queued * 0.67::DOUBLE * 365 AS queue_cost
        FROM per_site s LEFT JOIN (SELECT site_id, count(DISTINCT station_id) AS active FROM plugins GROUP BY site_id) a USING (site_id) JOIN medians m USING (site_id) JOIN peak_names p USING (site_id)""",
    # space
    "reach": f"SELECT s.station_id, n.node_id, n.traffic_volume, n.free_flow_speed, {hav('s', 'n')} AS d FROM stations s, nodes n",
    "best_reach": "SELECT *, true AS in_reach FROM reach WHERE d <= 10 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY traffic_volume DESC, node_id) = 1",
    "roads": """SELECT station_id, node_id, traffic_volume, free_flow_speed, in_reach FROM best_reach UNION ALL
        (SELECT station_id, node_id, traffic_volume, free_flow_speed, false FROM reach WHERE station_id NOT IN (SELECT station_id FROM best_reach) QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY d, node_id) = 1)""",
    "station_areas": near_join("", "stations", "areas", "station_id", "area_id", "r.area_id, r.population_estimate", ties=True),
    "features": "SELECT s.*, r.traffic_volume, r.free_flow_speed, a.area_id, a.population_estimate FROM stations s JOIN roads r USING (station_id) LEFT JOIN station_areas a USING (station_id)",
    "site_demand": "SELECT site_id, sum(m) AS avg_misses_per_day, sum(o)::BIGINT AS o_total, max(days) AS days_observed FROM hourly GROUP BY site_id",
    "rates": f"""SELECT f.*, d.avg_misses_per_day, d.o_total, d.days_observed, d.o_total / d.days_observed AS avg_plugins_per_day, d.o_total / d.days_observed + d.avg_misses_per_day AS daily_demand,
        (d.o_total / d.days_observed + d.avg_misses_per_day) / nullif(f.traffic_volume, 0) AS turnin_rate, (d.o_total / d.days_observed + d.avg_misses_per_day) / nullif(f.traffic_volume * {EV_2023}::DOUBLE, 0) AS ev_turnin_rate
        FROM features f LEFT JOIN site_demand d USING (site_id)""",
    "strata": "SELECT 'all' AS stratum, * FROM rates WHERE ev_turnin_rate <= 1 UNION ALL SELECT CASE WHEN kw_rated < 50 THEN 'destination' ELSE 'journey' END, * FROM rates WHERE ev_turnin_rate <= 1",
    # graph
    "keyed": f"SELECT *, {NODE_KEY} AS node FROM vertices",
    "stepped": "SELECT *, lead(node) OVER w AS b, lead(lat) OVER w AS lat_b, lead(lon) OVER w AS lon_b FROM keyed WINDOW w AS (PARTITION BY road_id ORDER BY seq)",
    "segments": f"SELECT p.road_id, p.seq, p.node AS a, p.b, {hav('p', 'q')} AS length, {hav('p', 'q')} / p.free_flow_speed AS time FROM stepped p, LATERAL (SELECT p.lat_b AS lat, p.lon_b AS lon) q WHERE p.b IS NOT NULL AND p.node <> p.b",
    "road_edges": "SELECT src, dst, max_by(length, o) AS length, max_by(time, o) AS time FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, length, time, (road_id, seq) AS o FROM segments) GROUP BY src, dst",
}


def _gap_parts(near: str, pairs: str, lengths: str, parts: str, distances: str, rows: str, threshold: int) -> dict[str, str]:
    """The steps from routes to ranked gaps for one kind of facility."""
    return {
        pairs: f"SELECT s.*, n.lat, n.lon, c.facility_name, lead(n.lat) OVER w AS lat_b, lead(n.lon) OVER w AS lon_b, lead(s.node_id) OVER w AS node_b, lead(c.facility_name) OVER w AS name_b FROM route_steps s JOIN graph_nodes n USING (node_id) LEFT JOIN {near} c USING (node_id) WINDOW w AS (PARTITION BY origin, dest ORDER BY seq)",
        lengths: f"SELECT p.origin, p.dest, p.seq, p.node_id, {hav('p', 'q')} AS step_km, coalesce(p.facility_name, p.name_b) AS passed FROM {pairs} p, LATERAL (SELECT p.lat_b AS lat, p.lon_b AS lon) q WHERE p.node_b IS NOT NULL",
        parts: f"SELECT *, sum((passed IS NOT NULL)::INT) OVER (PARTITION BY origin, dest ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM {lengths}",
        distances: f"""SELECT origin, dest, seq, node_id, sum(CASE WHEN passed IS NULL THEN step_km ELSE 0 END) OVER (PARTITION BY origin, dest, part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS distance_km,
            last_value(passed IGNORE NULLS) OVER (PARTITION BY origin, dest ORDER BY seq ROWS UNBOUNDED PRECEDING) AS facility_name FROM {parts}""",
        rows: f"""SELECT g.node_id, g.origin, g.dest, g.distance_km, g.facility_name, 1000 + g.origin * 379 % 9000 AS origin_population, 1000 + g.dest * 379 % 9000 AS dest_population FROM {distances} g WHERE distance_km > {threshold}
            QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY round(distance_km, 9) DESC, origin_population DESC, dest_population DESC, origin, dest, seq) = 1""",
    }


def _edges(pairs: str) -> str:
    return f"""SELECT e.src, e.dst, {hav('a', 'b')} AS length, {hav('a', 'b')} / e.speed AS time FROM (SELECT least(i, j) AS src, greatest(i, j) AS dst, max(50 + i % 50) AS speed FROM {pairs} WHERE i <> j GROUP BY ALL) e
        JOIN graph_nodes a ON a.node_id = e.src JOIN graph_nodes b ON b.node_id = e.dst"""


PARTS |= {
    "connected_edges": _edges("connected_pairs"),
    "block_edges": _edges("block_pairs"),
    "block_both": "SELECT src, dst FROM block_edges UNION ALL SELECT dst, src FROM block_edges",
    "reached_blocks(node_id, other)": "SELECT node_id, node_id FROM graph_nodes UNION SELECT r.node_id, e.dst FROM reached_blocks r JOIN block_both e ON e.src = r.other",
    "components": "SELECT node_id, min(other) AS component FROM reached_blocks GROUP BY node_id",
    "connected_nodes": "SELECT * FROM graph_nodes WHERE node_id IN (SELECT src FROM connected_edges UNION ALL SELECT dst FROM connected_edges)",
    "linked_nodes": "SELECT * FROM nodes WHERE (node_id % 4 IN (0, 1) AND node_id + 1 IN (SELECT node_id FROM nodes)) OR ((node_id - 1) % 4 IN (0, 1) AND node_id - 1 IN (SELECT node_id FROM nodes))",
    "town_nodes": near_join("", "hubs", "connected_nodes", "hub_id", "node_id", "r.node_id"),
    "town_ends": "SELECT src AS node_id, time FROM connected_edges UNION ALL SELECT dst, time FROM connected_edges UNION ALL SELECT -hub_id - 1, 1::DOUBLE FROM town_nodes UNION ALL SELECT node_id, 1::DOUBLE FROM town_nodes",
    "town_places": "SELECT node_id, lat, lon, false AS is_town FROM graph_nodes UNION ALL SELECT -hub_id - 1, lat, lon, true FROM hubs",
    "comp_links": f"""SELECT a.component AS ca, b.component AS cb, {hav('a', 'b')} AS d, least(a.node_id, b.node_id) AS src, greatest(a.node_id, b.node_id) AS dst
        FROM (SELECT * FROM graph_nodes JOIN components USING (node_id)) a JOIN (SELECT * FROM graph_nodes JOIN components USING (node_id)) b ON a.component < b.component
        QUALIFY row_number() OVER (PARTITION BY a.component, b.component ORDER BY {hav('a', 'b')}, least(a.node_id, b.node_id), greatest(a.node_id, b.node_id)) = 1""",
    "smaller_links(src, dst, comp)": """SELECT src, dst, ca FROM comp_links UNION SELECT s.src, s.dst, CASE WHEN f.ca = s.comp THEN f.cb ELSE f.ca END
        FROM smaller_links s JOIN comp_links e ON e.src = s.src AND e.dst = s.dst JOIN comp_links f ON (f.ca = s.comp OR f.cb = s.comp) AND (f.d, f.src, f.dst) < (e.d, e.src, e.dst)""",
    "links": "SELECT src, dst, time AS w FROM connected_edges UNION ALL SELECT dst, src, time FROM connected_edges",
    "costs(origin, node_id, cost) USING KEY (origin, node_id)": """SELECT DISTINCT node_id, node_id, 0::DOUBLE FROM town_nodes UNION
        SELECT c.origin, l.dst, min(c.cost + l.w) FROM costs c JOIN links l ON l.src = c.node_id LEFT JOIN recurring.costs k ON k.origin = c.origin AND k.node_id = l.dst WHERE k.cost IS NULL OR c.cost + l.w < k.cost GROUP BY ALL""",
    "paths": "SELECT c.origin, c.node_id, c.cost, CASE WHEN c.cost > 0 THEN (SELECT min(l.src) FROM links l JOIN costs p ON p.node_id = l.src WHERE l.dst = c.node_id AND p.origin = c.origin AND p.cost + l.w = c.cost) END AS pred FROM costs c",
    "walks(from_node, dest, cur, path, road_cost)": """SELECT p.origin, t.hub_id, p.node_id, [p.node_id], p.cost FROM paths p JOIN town_nodes t ON t.node_id = p.node_id UNION ALL
        SELECT w.from_node, w.dest, p.pred, list_prepend(p.pred, w.path), w.road_cost FROM walks w JOIN paths p ON p.origin = w.from_node AND p.node_id = w.cur WHERE p.pred IS NOT NULL""",
    "routes": "SELECT t.hub_id AS origin, w.dest, w.path, w.road_cost, w.road_cost + CASE WHEN t.hub_id = w.dest THEN 0 ELSE 2 END AS cost FROM walks w JOIN town_nodes t ON t.node_id = w.from_node WHERE w.cur = w.from_node",
    "near_chargers": f"SELECT n.node_id, max_by(s.name, s.station_id) AS facility_name FROM graph_nodes n JOIN stations s ON {hav('n', 's')} <= 20 GROUP BY n.node_id",
    "near_hubs": f"SELECT n.node_id, max_by(s.name, s.hub_id) AS facility_name FROM graph_nodes n JOIN (SELECT * FROM hubs WHERE hub_id % 5 = 0) s ON {hav('n', 's')} <= 20 GROUP BY n.node_id",
    "route_steps": "SELECT origin, dest, unnest(range(len(path))) AS seq, unnest(path) AS node_id FROM routes",
    **_gap_parts("near_chargers", "route_pairs", "route_lengths", "route_parts", "gap_distances", "gaps", 75),
    **_gap_parts("near_hubs", "hub_pairs", "hub_lengths", "hub_parts", "hub_distances", "hub_gap_rows", 200),
    # prediction
    "training": "SELECT p_partkey, p_size::DOUBLE AS p_size, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS p_retailprice, p_brand, p_type, (p_size * 2 + p_partkey % 13)::DOUBLE AS target FROM part WHERE p_partkey % 11 <> 0",
    "matrix_frame": """SELECT p_partkey, p_size, coalesce(p_retailprice, avg(p_retailprice) OVER ()) AS p_retailprice, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS p_brand, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS p_type, target FROM training""",
    "arrivals": "SELECT station_id AS charger_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS hour FROM availabilities WHERE status = 'Occupied'",
    "kept": "SELECT charger_id, unnest(list_reduce(list_transform(list_sort(list(hour)), lambda x: [x]), lambda k, x: CASE WHEN x[1] >= k[-1] + 3 THEN list_append(k, x[1]) ELSE k END)) AS hour FROM arrivals GROUP BY charger_id",
    "kept_counts": "SELECT charger_id, count(*) AS n FROM kept GROUP BY charger_id",
}



def rate(t: str) -> str:
    w = "(2 * pi() / 24)"
    x = [f"({v!r}::DOUBLE)" for v in RATE]
    return f"({x[0]} + {x[1]} * (1 + sin({w} * {t})) + {x[2]} * (1 + sin(2 * {w} * {t})) + {x[3]} * (1 + cos({w} * {t})) + {x[4]} * (1 + cos(2 * {w} * {t})))"


def projected(epsg: int) -> str:
    """node_id, lat, lon, east, north of all nodes by the series of the transverse Mercator projection."""
    e, radius, alpha, _ = geo._series()
    meridian, scale, east, north = geo.ZONES[epsg]
    d = lambda v: f"({v!r}::DOUBLE)"
    y = " + ".join(["xi", *(f"{d(a)} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(alpha, 1))])
    x = " + ".join(["eta", *(f"{d(a)} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(alpha, 1))])
    isometric = f"SELECT *, sinh(atanh(sin(radians(lat))) - {d(e)} * atanh({d(e)} * sin(radians(lat)))) AS t, radians(lon - {d(meridian)}) AS d FROM nodes"
    angles = f"SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM ({isometric})"
    return f"SELECT node_id, lat, lon, ({x}) * {d(scale * radius)} + {d(east)} AS east, ({y}) * {d(scale * radius)} + {d(north)} AS north FROM ({angles})"


TOP = RATE[0] + sum(abs(x) + x for x in RATE[1:])
MOST = int(TOP * 24 + 12 * math.sqrt(TOP * 24) + 30)


def uniform(seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}|0|' || day || '|' || i), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def primitive(t: str) -> str:
    w = "(2 * pi() / 24)"
    return f"({sum(RATE)!r}::DOUBLE * ({t}) - {RATE[1]!r}::DOUBLE / {w} * cos({w} * ({t})) - {RATE[2]!r}::DOUBLE / (2 * {w}) * cos(2 * {w} * ({t})) + {RATE[3]!r}::DOUBLE / {w} * sin({w} * ({t})) + {RATE[4]!r}::DOUBLE / (2 * {w}) * sin(2 * {w} * ({t})))"


FINAL: dict[str, str] = {
    "towns_over_threshold": f"SELECT name, {r6('lat', 'lon')}, population FROM towns WHERE population > 2000 AND town_id % 9 <> 8",
    "active_stations": f"SELECT station_id, s.site_id, name, {r6('lat', 'lon')}, kw_rated FROM stations s JOIN sites t ON t.site_id = s.site_id WHERE s.provider_deleted <> 1 AND t.provider_deleted <> 1 AND installation_status = 'Commissioned'",
    "availability_scan": f"SELECT a.event_id, a.station_id, s.site_id, a.ts, {local('a.ts')} AS local_ts, a.status FROM availabilities a JOIN stations s USING (station_id) JOIN sites t ON t.site_id = s.site_id WHERE s.provider_deleted = 0 AND t.provider_deleted = 0 AND a.ts >= '2024-01-05' AND a.ts < '2024-01-25'",
    "island_split": f"SELECT station_id, CASE WHEN {in_south('lon', 'lat')} THEN 'South' ELSE 'North' END AS island FROM stations",
    "all_stations": f"SELECT station_id, site_id, CASE WHEN {in_south('lon', 'lat')} THEN 'South' ELSE 'North' END AS island, installation_status FROM stations",
    "dedup_status": "SELECT station_id, site_id, ts, status, prev_status FROM transitions",
    "state_durations": "SELECT station_id, ts, status, next_ts, duration_us FROM durations",
    "status_duration_stats": f"SELECT station_id, status, {r6('median_s', 'iqr_s')} FROM duration_stats",
    "suspicious_flags": "SELECT station_id, ts, status, is_suspicious FROM flagged",
    "plugin_events": "SELECT station_id, site_id, ts, local_ts FROM plugins",
    "plugins_by_hour": "SELECT * FROM by_hour",
    "resample_status": "SELECT station_id, site_id, make_timestamp(slot * 600000000) AS grid_ts, status FROM resampled",
    "status_steps": "SELECT station_id, ts, CASE status WHEN 'Available' THEN 0::DOUBLE WHEN 'Unavailable' THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS level, is_suspicious FROM flagged",
    "site_station_matrix": "SELECT site_id, ts, station_id, status, is_suspicious FROM matrix",
    "site_status": "SELECT site_id, ts, local_ts, status, is_suspicious FROM states",
    "site_status_null_as_occupied": "SELECT site_id, ts, CASE WHEN bool_or(coalesce(status, '') = 'Available') THEN 'Available' WHEN bool_and(coalesce(status, '') = 'Unavailable') THEN 'Unavailable' ELSE 'Occupied' END AS status FROM matrix GROUP BY site_id, ts",
    "site_status_counts": "SELECT site_id, ts, count(*) FILTER (status = 'Available') AS n_available, count(*) FILTER (status = 'Occupied') AS n_occupied, count(*) FILTER (status = 'Unavailable') AS n_unavailable, count(status) AS n_total FROM matrix GROUP BY ALL",
    "site_grid_status": "SELECT site_id, status, count(*) AS points FROM grid GROUP BY ALL",
    "hourly_status_pct": f"SELECT site_id, hour, {r6('pct_available', 'pct_occupied', 'pct_unavailable')} FROM percentages",
    "unique_days": "SELECT * FROM days",
    "median_occupied": f"SELECT site_id, {r6('median_occupied_s')} FROM medians",
    "median_occupied_spell": """SELECT site_id, round(coalesce(quantile_cont(us::DOUBLE, 0.5) FILTER (status = 'Occupied') / 1e6, 0::DOUBLE), 6) AS median_occupied_s FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY site_id ORDER BY ts)) - epoch_us(ts) AS us
        FROM (SELECT *, lag(status) OVER (PARTITION BY site_id ORDER BY ts) AS was FROM states) WHERE status IS DISTINCT FROM was) GROUP BY site_id""",
    "plot_eligible_sites": "SELECT site_id, count(*) AS transitions FROM flagged GROUP BY site_id HAVING count(*) >= 30",
    "queued_plugins": "SELECT station_id, site_id, ts FROM queued",
    "hourly_demand": f"SELECT site_id, hour, days, {r6('a')}, o, q_count, free_arrivals, {r6('true_arrivals', 'missed', 'q', 'free_rate', 'm', 'r')} FROM hourly",
    "hourly_plot_state": """SELECT site_id, CASE WHEN sum(coalesce(q, 0) + coalesce(free_rate, 0) + coalesce(m, 0) + coalesce(r, 0)) = 0 THEN 'No data' WHEN max(coalesce(q, 0) + coalesce(free_rate, 0)) < 0.1 AND max(coalesce(m, 0)) < 0.1 THEN 'Insufficient' ELSE 'Plot' END AS plot_state FROM hourly GROUP BY site_id""",
    "peak_hours": "SELECT * FROM peak_names",
    "site_stats": f"SELECT site_id, stations_with_plugins, {r6('daily_charges', 'daily_queued', 'daily_missed', 'median_occupied_s')}, peak, evs_supported, national_benefit, missed_cost, round(queue_cost, 4) AS queue_cost FROM site_stats",
    "site_stats_display": "SELECT site_id, coalesce(round_even(daily_charges, 1), 0) AS daily_charges, coalesce(round_even(daily_queued, 1), 0) AS daily_queued, coalesce(round_even(daily_missed, 1), 0) AS daily_missed, '$' || format('{:,}', missed_cost) AS missed_cost, CASE WHEN queue_cost = 0 THEN '0' ELSE '$' || format('{:,}', round_even(queue_cost, 0)::BIGINT) END AS queue_cost, strftime(make_timestamp(trunc(median_occupied_s)::BIGINT * 1000000), '%H:%M:%S') AS charge_time, peak, '~' || evs_supported || ' EVs' AS evs_supported, '$' || format('{:,}', national_benefit) AS national_benefit FROM site_stats",
    "turn_in_rates": f"SELECT station_id, site_id, {r6('avg_misses_per_day', 'avg_plugins_per_day', 'daily_demand', 'turnin_rate', 'ev_turnin_rate')}, o_total, days_observed, traffic_volume FROM rates",
    "demand_strata": "SELECT stratum, count(*) AS stations, round(avg(ev_turnin_rate), 6) AS mean_rate FROM strata GROUP BY stratum",
    "turnin_summary": "SELECT stratum, count(ev_turnin_rate) AS n, round(avg(ev_turnin_rate), 6) AS mean, round(stddev_samp(ev_turnin_rate), 6) AS std, round(min(ev_turnin_rate), 6) AS low, round(quantile_cont(ev_turnin_rate, 0.25), 6) AS q25, round(quantile_cont(ev_turnin_rate, 0.5), 6) AS q50, round(quantile_cont(ev_turnin_rate, 0.75), 6) AS q75, round(max(ev_turnin_rate), 6) AS high FROM strata GROUP BY stratum",
    "turnin_histogram": "SELECT stratum, least(floor(ev_turnin_rate / 0.05::DOUBLE)::BIGINT, 19) AS bin, count(*) AS n FROM strata WHERE ev_turnin_rate BETWEEN 0 AND 1 GROUP BY ALL",
    "correction_formulas": """SELECT site_id, hour, round(CASE WHEN u * 0.5::DOUBLE < 1 THEN u / (1 - u * 0.5::DOUBLE) END, 6) AS dead_time_rate, round(CASE WHEN u * 0.5::DOUBLE < 1 THEN u / (1 - u * 0.5::DOUBLE) END - u, 6) AS dead_time_lost,
        round(u - v, 6) AS joined, round((u - v) / nullif(1 - f, 0), 6) AS rate, round((u - v) / nullif(1 - f, 0) - (u - v) - v, 6) AS lost FROM (SELECT site_id, hour, o / days AS u, q_count / days AS v, 1 - a AS f FROM hourly)""",
    "station_markers": """SELECT s.station_id, round(sqrt(25 + 10 * coalesce(t.daily_charges, 0)), 6) AS radius, round(greatest(0::DOUBLE, least(1::DOUBLE, coalesce(t.daily_missed, 0) / 2)), 6) AS shade,
        '<b>' || s.name || ':</b><br>Power: ' || s.kw_rated::INT || '<br>Status: ' || s.installation_status || '<br>' AS tooltip FROM stations s LEFT JOIN site_stats t USING (site_id)""",
    "near_facility_nodes": f"SELECT n.node_id, max_by(s.name, s.station_id) AS facility_name, count(*) AS facilities FROM nodes n JOIN stations s ON {hav('n', 's')} <= 20 GROUP BY n.node_id",
    "nearest_node": f"SELECT town_id, node_id, {r6('distance_km')} FROM ({near_join('', 'towns', 'linked_nodes', 'town_id', 'node_id', 'r.node_id')})",
    "nearest_area": f"SELECT station_id, area_id, population_estimate, {r6('distance_km')} FROM station_areas",
    "nearby_road_attributes": "SELECT station_id, node_id, traffic_volume, free_flow_speed, in_reach FROM roads",
    "neighbor_stats": f"""SELECT f.station_id, coalesce(s.neighbors, 0) AS neighbors, s.mean_distance_km, s.mean_population_estimate, s.mean_traffic_volume, s.mean_free_flow_speed FROM features f LEFT JOIN
        (SELECT a.station_id, count(*) AS neighbors, round(avg({hav('a', 'b')}), 6) AS mean_distance_km, round(avg(b.population_estimate), 6) AS mean_population_estimate, round(avg(b.traffic_volume), 6) AS mean_traffic_volume, round(avg(b.free_flow_speed), 6) AS mean_free_flow_speed
        FROM stations a JOIN features b ON {hav('a', 'b')} > 0 AND {hav('a', 'b')} <= 25 GROUP BY a.station_id) s USING (station_id)""",
    "projected_nodes": f"SELECT node_id, round(east, 3) AS east, round(north, 3) AS north, round(lat, 7) AS lat, round(lon, 7) AS lon FROM ({projected(2193)})",
    "polyline_segments": f"SELECT road_id, seq, a, b, {r6('length', 'time')} FROM segments",
    "road_graph": f"SELECT src, dst, {r6('length', 'time')} FROM road_edges",
    "road_nodes": f"SELECT node AS node_id, round(min_by(lat, (road_id, seq)), 6) AS lat, round(min_by(lon, (road_id, seq)), 6) AS lon, min_by(free_flow_speed, (road_id, seq)) AS free_flow_speed, min_by(traffic_volume, (road_id, seq)) AS traffic_volume FROM keyed GROUP BY node",
    "node_degree": "SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM road_edges UNION ALL SELECT dst FROM road_edges) GROUP BY node_id",
    "connected_components": "SELECT node_id, component FROM components",
    "component_closest_pair": f"SELECT least(a.node_id, b.node_id) AS src, greatest(a.node_id, b.node_id) AS dst, round({hav('a', 'b')}, 6) AS distance_km FROM (SELECT * FROM graph_nodes JOIN components USING (node_id)) a JOIN (SELECT * FROM graph_nodes JOIN components USING (node_id)) b ON a.component < b.component ORDER BY {hav('a', 'b')}, 1, 2 LIMIT 1",
    "stitch_edges": f"""SELECT a.node_id AS src, b.node_id AS dst, round({hav('a', 'b')} * sqrt(2), 6) AS length, round({hav('a', 'b')} * sqrt(2) / 100, 6) AS time FROM nodes a JOIN nodes b ON a.node_id < b.node_id AND b.node_id <> a.node_id + 1 AND (a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon) <= (20 / 111::DOUBLE) * (20 / 111::DOUBLE)""",
    "shortest_paths": f"SELECT origin, node_id, {r6('cost')}, pred FROM paths",
    "town_routes": f"SELECT origin, dest, array_to_string(path, '>') AS path, {r6('road_cost', 'cost')} FROM routes",
    "route_geometry": "SELECT r.origin, r.dest, len(r.path)::INT AS points, round(a.lon, 6) AS first_lon, round(a.lat, 6) AS first_lat, round(b.lon, 6) AS last_lon, round(b.lat, 6) AS last_lat FROM routes r JOIN graph_nodes a ON a.node_id = r.path[1] JOIN graph_nodes b ON b.node_id = r.path[-1]",
    "distance_since_facility": f"SELECT origin, dest, seq::INT AS seq, node_id, {r6('distance_km')}, facility_name FROM gap_distances",
    "ranked_gaps": f"SELECT node_id, origin, dest, {r6('distance_km')}, facility_name, origin_population, dest_population FROM gaps",
    "gap_routes": "SELECT DISTINCT origin, dest FROM gaps",
    "hub_gaps": f"SELECT node_id, origin, dest, {r6('distance_km')}, facility_name, origin_population, dest_population FROM hub_gap_rows",
    "hub_gap_routes": "SELECT DISTINCT origin, dest FROM hub_gap_rows",
    "town_graph": "SELECT p.node_id, round(p.lat, 6) AS lat, round(p.lon, 6) AS lon, p.is_town, count(*) AS degree, round(sum(e.time), 6) AS time FROM town_places p JOIN town_ends e USING (node_id) GROUP BY ALL",
    "patch_components": "SELECT src, dst, round(d, 6) AS length, round(d / 50, 6) AS time FROM comp_links e WHERE NOT EXISTS (SELECT 1 FROM smaller_links s WHERE s.src = e.src AND s.dst = e.dst AND s.comp = e.cb)",
    "standardised_features": "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) + 0::DOUBLE AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) + 0::DOUBLE AS p_retailprice, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT % 5 = 0 AS held_out FROM matrix_frame",
    "simulate_arrivals": f"""SELECT 0::BIGINT AS charger_id, round(day * 24 + t, 6) AS hour FROM (SELECT day, i, sum(-ln({uniform(7)}) / {TOP!r}::DOUBLE) OVER (PARTITION BY day ORDER BY i ROWS UNBOUNDED PRECEDING) AS t
        FROM range({DAYS}) d(day), range(1, {MOST + 1}) r(i)) WHERE t < 24 AND {uniform(8)} <= {rate('t')} / {TOP!r}::DOUBLE""",
    "feature_matrix": f"SELECT p_partkey, p_size, {r6('p_retailprice')}, p_brand, p_type, target FROM matrix_frame",
    "prediction_metrics": "SELECT count(*) AS n, round(corr(target, p), 6) AS r, round(1 - sum((target - p) ** 2) / sum((target - m) ** 2), 6) AS r2 FROM (SELECT target, p_size * 1.9::DOUBLE + 7.5::DOUBLE AS p, avg(target) OVER () AS m FROM matrix_frame)",
    "dead_time_filter": f"SELECT charger_id, {r6('hour')} FROM kept",
    "collisions_per_day": "SELECT charger_id, round(count(*) / 30, 6) AS arrivals_per_day, round(max(k.n) / 30, 6) AS plugins_per_day, round((count(*) - max(k.n)) / 30, 6) AS blocked_per_day FROM arrivals JOIN kept_counts k USING (charger_id) GROUP BY charger_id",
    "intensity_grid": f"SELECT hour, round({rate('hour')}, 6) AS rate, round(CASE WHEN {rate('hour')} * 3 < 1 THEN 1 / (1 - {rate('hour')} * 3) END, 6) AS factor, round(CASE WHEN {primitive('hour')} - {primitive('hour - 3')} < 1 THEN 1 / (1 - ({primitive('hour')} - {primitive('hour - 3')})) END, 6) AS factor_exact FROM (SELECT i / 10 AS hour FROM range(240) t(i))",
    "ev_shares": "SELECT * FROM (VALUES " + ", ".join(f"({y}, {s}::DOUBLE)" for y, s in EV_SHARE.items()) + ") v(year, share)",
    "streaming_hourly_counts": "SELECT date_trunc('hour', ts) AS hour_start, status, count(*) AS n FROM availabilities GROUP BY ALL",
    "streaming_plugins": "SELECT station_id, site_id, ts FROM (SELECT *, lag(status) OVER (PARTITION BY station_id ORDER BY ts) AS before FROM latest) WHERE status = 'Occupied' AND before IS DISTINCT FROM 'Occupied'",
}


def _name(part: str) -> str:
    return re.match(r"\w+", part)[0]


def build(final: str) -> str:
    """The final SQL with the parts that it needs, in their order."""
    needed: set[str] = set()
    todo = [final]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for part, sql in PARTS.items():
            if _name(part) in words and part not in needed:
                needed.add(part)
                todo.append(sql)
    if not needed:
        return final
    parts = [f"{p} AS ({sql})" for p, sql in PARTS.items() if p in needed]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


ORACLES = {name: build(sql) for name, sql in FINAL.items()}
