import math
import random

import pytest
from pyspark.sql import functions as F

from voltweave.config import Params
from voltweave.functions import geo
from voltweave.operators import gaps, graph, spatial


def km(a, b):
    (la, oa), (lb, ob) = a, b
    la, oa, lb, ob = map(math.radians, (la, oa, lb, ob))
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2))


def points(n, seed, spread=3.0):
    rng = random.Random(seed)
    return {i: (-42 + rng.random() * spread, 171 + rng.random() * spread) for i in range(n)}


def frame(spark, at, key="node_id"):
    return spark.createDataFrame([(i, *p) for i, p in at.items()], f"{key} long, lat double, lon double")


def test_distance_and_ring(spark):
    one = spark.range(1)
    assert one.select(geo.haversine(*map(F.lit, (-41.29, 174.77, -36.85, 174.76)))).first()[0] == pytest.approx(493.706910, abs=1e-6)
    places = {(172.63, -43.53): "South", (173.28, -41.27): "South", (174.76, -36.85): "North", (174.77, -41.29): "North"}
    for (x, y), want in places.items():
        assert one.select(geo.island(F.lit(x), F.lit(y))).first()[0] == want


def test_projection(spark):
    one = spark.range(1)
    # On the central meridian at the equator: the false origin.
    east, north = geo.project(F.lit(0.0), F.lit(173.0), 2193)
    assert one.select(east, north).first() == pytest.approx((1600000, 10000000))
    for lat, lon in ((-41.3, 174.8), (-46.5, 167.0), (-34.5, 178.4)):
        for epsg in (2193, 32760):
            back = geo.unproject(*geo.project(F.lit(lat), F.lit(lon), epsg), epsg)
            assert one.select(*back).first() == pytest.approx((lat, lon), abs=1e-8)
    # A degree of latitude near 41 S is 111.05 km on the ellipsoid.
    a, b = (one.select(geo.project(F.lit(x), F.lit(173.0), 2193)[1]).first()[0] for x in (-41.5, -40.5))
    assert (b - a) / 0.9996 == pytest.approx(111_046, abs=30)


def test_shapes(spark):
    row = spark.sql("SELECT array(array(struct(1D AS lon, 2D AS lat), struct(3D AS lon, 4D AS lat))) AS parts, array(struct(0D AS lon, 0D AS lat), struct(4D AS lon, 0D AS lat), struct(4D AS lon, 2D AS lat), struct(0D AS lon, 2D AS lat), struct(0D AS lon, 0D AS lat)) AS ring")
    got = row.select(geo.first_vertex(F.col("parts")).alias("v"), *geo.ring_centroid(F.col("ring"))).first()
    assert tuple(got.v) == (1, 2) and got[1:] == (2, 1)
    names = spark.createDataFrame([("(-41.1, 174.2)",), ("nowhere",), ("__import__('os')",)], "n string")
    lat, lon = geo.parse_node(F.col("n"))
    assert [tuple(r) for r in names.select(lat, lon).collect()] == [(-41.1, 174.2), (None, None), (None, None)]


@pytest.mark.parametrize("radius", [5.0, 40.0, 400.0])
def test_radius_join(spark, radius):
    left, right = points(60, 1), points(70, 2)
    got = spatial.radius_join(frame(spark, left, "a"), frame(spark, right, "b"), radius)
    want = {(i, j) for i in left for j in right if km(left[i], right[j]) <= radius}
    assert {(r.a, r.b) for r in got.collect()} == want and got.count() == len(want)


def test_nearest_join(spark):
    left, right = points(30, 3, 9.0), points(20, 4, 9.0)
    right[100] = right[5]
    for ties in (False, True):
        got = spatial.nearest_join(frame(spark, left, "a"), frame(spark, right, "b"), "a", "b", ties=ties, start_km=10).collect()
        want = set()
        for i in left:
            least = min(km(left[i], p) for p in right.values())
            equal = [j for j in right if km(left[i], right[j]) == least]
            want |= {(i, j) for j in (equal if ties else [min(equal)])}
        assert {(r.a, r.b) for r in got} == want


def test_facilities_and_road_attributes(spark):
    nodes = spark.createDataFrame([(1, -41.0, 174.0, 100.0, 60.0), (2, -41.01, 174.0, 300.0, 70.0), (3, -41.02, 174.0, 300.0, 80.0), (4, -45.0, 170.0, None, 90.0), (5, -44.0, 171.0, 5.0, 50.0)], "node_id long, lat double, lon double, traffic_volume double, free_flow_speed double")
    stations = spark.createDataFrame([(1, -41.0, 174.01), (2, -45.0, 170.0)], "station_id long, lat double, lon double")
    got = {r.station_id: (r.node_id, r.in_reach) for r in spatial.road_attributes(stations, nodes, "station_id").collect()}
    assert got == {1: (2, True), 2: (5, False)}
    facilities = spark.createDataFrame([(7, "first", -41.0, 174.0), (8, "last", -41.1, 174.0)], "facility_id long, facility_name string, lat double, lon double")
    for how, want in (("last", "last"), ("nearest", "first")):
        names = {r.node_id: r.facility_name for r in spatial.near_facilities(nodes, facilities, how=how).collect()}
        assert names == {1: want, 2: want, 3: want}


def make_edges(spark, pairs, at):
    rows = [(min(a, b), max(a, b), km(at[a], at[b]), km(at[a], at[b]) / 50) for a, b in pairs]
    return spark.createDataFrame(rows, "src long, dst long, length double, time double")


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def test_components_and_patches(spark, monkeypatch):
    at = points(26, 6)
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(26), 2))) for _ in range(15)}
    edges, nodes = make_edges(spark, pairs, at), frame(spark, at)
    root = {i: i for i in at}
    for a, b in pairs:
        x, y = sorted((find(root, a), find(root, b)))
        root[y] = x
    got = {r.node_id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {i: find(root, i) for i in at}
    want = set()
    for d, a, b in sorted((km(at[a], at[b]), a, b) for a in at for b in at if a < b):  # the shortest tree, link by link
        if (x := find(root, a)) != (y := find(root, b)):
            root[max(x, y)] = min(x, y)
            want.add((a, b))
    patched = graph.patch_components(nodes, edges)
    assert {(r.src, r.dst) for r in patched.collect()} == want
    monkeypatch.setattr(graph, "LOCAL_LINKS", 0)
    assert {(r.src, r.dst) for r in graph.patch_components(nodes, edges).collect()} == want
    whole = edges.unionByName(patched)
    assert graph.connected_components(nodes, whole).select("component").distinct().count() == 1
    assert graph.patch_components(nodes, whole).count() == 0


def test_contraction(spark):
    rows = [(1, 2, 0.3, 1.0), (2, 3, 0.3, 1.0), (3, 4, 0.3, 1.0), (4, 5, 5.0, 1.0), (3, 6, 0.1, 1.0), (7, 8, 0.2, 1.0), (8, 9, 0.2, 1.0), (7, 9, 0.1, 9.0), (9, 10, 3.0, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, length double, time double")
    got = {(r.src, r.dst): (round(r.length, 6), r.time) for r in graph.contract_graph(edges).collect()}
    # 2 goes; 4 stays (5.3 km); of 7 and 8 in the triangle the smaller goes first, and its way is the slower one
    assert got[1, 3] == (0.6, 2.0) and (3, 4) in got and (4, 5) in got and (3, 6) in got
    assert not any(7 in e for e in got)


def test_shortest_paths_and_routes(spark):
    at = points(30, 9)
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(55)}
    edges = make_edges(spark, pairs, at)
    origins = spark.createDataFrame([(0,), (7,), (29,)], "origin long")
    got = {(r.origin, r.node_id): r for r in graph.shortest_paths(edges, origins).collect()}
    for o in (0, 7, 29):
        cost = {o: 0.0}
        for _ in range(30):
            for a, b in pairs:
                w = km(at[a], at[b]) / 50
                for x, y in ((a, b), (b, a)):
                    if x in cost and cost[x] + w < cost.get(y, 1e9):
                        cost[y] = cost[x] + w
        assert {k[1]: pytest.approx(r.cost) for k, r in got.items() if k[0] == o} == cost
    towns = spark.createDataFrame([(100, 0), (101, 7), (102, 29)], "town_id long, node_id long")
    routes = graph.town_routes(graph.shortest_paths(edges, origins), towns).collect()
    assert {(r.origin, r.dest) for r in routes} == {(a, b) for a in (100, 101, 102) for b in (100, 101, 102)}
    for r in routes:
        length = sum(km(at[a], at[b]) / 50 for a, b in zip(r.path, r.path[1:]))
        assert r.road_cost == pytest.approx(length) and all(tuple(sorted(e)) in pairs for e in zip(r.path, r.path[1:]))
        assert r.cost == pytest.approx(length + 2 * (r.origin != r.dest))
    lines = graph.route_geometry(spark.createDataFrame([(1, 2, [3, 5])], "origin long, dest long, path array<long>"), frame(spark, at)).first()
    assert lines.line == [[at[3][1], at[3][0]], [at[5][1], at[5][0]]]


@pytest.fixture(params=["worker", "rounds"])
def way(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
        monkeypatch.setattr(graph, "LOCAL_NODES", 0)
        monkeypatch.setattr(graph, "MERGE_ROUNDS", 2)
    return request.param


def test_paths_with_missing_and_zero_weights(spark, way):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, None), (3, 4, 0.0), (4, 5, 0.0), (3, 5, 0.0), (1, 9, 1.0), (5, 6, float("nan")), (20, 21, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, time double")
    origins = spark.createDataFrame([(9,), (1,), (None,), (77,), (9,)], "origin long")
    paths = graph.shortest_paths(edges, origins)
    got = {(r.origin, r.node_id): (r.cost, r.pred) for r in paths.collect()}
    # The missing weight of 1-3 is 1, as is that of 5-6; of the zero-weight ways the one of fewest steps counts.
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {1: (0.0, None), 2: (1.0, 1), 3: (1.0, 1), 4: (1.0, 3), 5: (1.0, 3), 6: (2.0, 5), 9: (1.0, 1)}
    assert got[9, 1] == (1.0, 9) and got[9, 6] == (3.0, 5) and got[77, 77] == (0.0, None) and len(got) == 15
    towns = spark.createDataFrame([(100, 9), (101, 6), (102, 4), (103, 77)], "town_id long, node_id long")
    routes = {(r.origin, r.dest): r.path for r in graph.town_routes(graph.shortest_paths(edges, towns.select(F.col("node_id").alias("origin"))), towns).collect()}
    assert routes[100, 101] == [9, 1, 3, 5, 6] and routes[100, 102] == [9, 1, 3, 4] and routes[103, 103] == [77] and len(routes) == 10
    with pytest.raises(Exception):
        graph.shortest_paths(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, time double"), origins).collect()
    ring = spark.createDataFrame([(1, 1, 0.0, None), (1, 2, 1.0, 3), (1, 3, 1.0, 2)], "origin long, node_id long, cost double, pred long")
    with pytest.raises(Exception):
        graph.town_routes(ring, spark.createDataFrame([(7, 1), (8, 2)], "town_id long, node_id long")).collect()


def test_both_ways_to_paths_agree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(min(a, b), max(a, b), rng.choice([0.0, 1.0, 1.0, 2.0])) for a, b in {tuple(sorted(rng.sample(range(25), 2))) for _ in range(60)}]
    edges = spark.createDataFrame(rows, "src long, dst long, time double")
    origins = spark.createDataFrame([(0,), (3,)], "origin long")
    one = sorted(map(tuple, graph.shortest_paths(edges, origins).collect()), key=str)
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    assert sorted(map(tuple, graph.shortest_paths(edges, origins).collect()), key=str) == one


def test_towns_take_nodes_with_edges_only(spark):
    nodes = frame(spark, {1: (-41.0, 174.0), 2: (-41.5, 174.0), 3: (-41.6, 174.0)})
    edges = spark.createDataFrame([(2, 3, 11.0, 0.2)], "src long, dst long, length double, time double")
    towns = spark.createDataFrame([(5, -41.0, 174.0)], "town_id long, lat double, lon double")
    attached = graph.attach_towns(towns, nodes, edges)
    assert attached.first().node_id == 2
    every, whole = graph.with_towns(nodes, edges, towns, attached)
    assert {(r.node_id, r.is_town) for r in every.collect()} == {(1, False), (2, False), (3, False), (-6, True)}
    assert (-6, 2, None, 1.0) in [tuple(r) for r in whole.collect()]


def test_facilities_of_one_name_are_one(spark):
    rows = [(1, "a", -41.0, 174.0), (2, "b", -41.0, 175.0), (3, "a", -43.0, 172.0), (4, None, -40.0, 174.0), (5, None, -39.0, 174.0)]
    got = spatial.named_once(spark.createDataFrame(rows, "facility_id long, facility_name string, lat double, lon double")).collect()
    assert sorted((r.facility_id, r.lat) for r in got) == [(1, -43.0), (2, -41.0), (4, -40.0), (5, -39.0)]


def test_segments_and_stitching(spark):
    v = [(1, 1, -41.0, 174.0, 50.0, 1.0), (1, 2, -41.0, 174.1, 50.0, 1.0), (1, 3, -41.000001, 174.100001, 50.0, 1.0), (2, 1, -41.0, 174.1, 100.0, 2.0), (2, 2, -41.0, 174.0, 100.0, 2.0)]
    vertices = spark.createDataFrame(v, "road_id long, seq long, lat double, lon double, free_flow_speed double, traffic_volume double")
    segments = graph.polyline_segments(vertices)
    assert segments.count() == 2
    edge = graph.road_graph(segments).collect()
    assert len(edge) == 1 and edge[0].time == pytest.approx(edge[0].length / 100)  # the last road sets it
    assert {r.free_flow_speed for r in graph.graph_nodes(vertices).collect()} == {50.0}  # the first vertex sets it
    at = points(40, 11, 0.6)
    edges = make_edges(spark, {(0, 1), (2, 3)}, at)
    got = {(r.src, r.dst) for r in graph.stitch_edges(frame(spark, at), edges).collect()}
    assert got == {(a, b) for a in at for b in at if a < b and math.dist(at[a], at[b]) <= 20 / 111 and (a, b) not in {(0, 1), (2, 3)}}


def test_stitching_sends_no_copies_to_the_driver(spark):
    # 40 nodes that lie dense in several cells and bands, two of one id, one without a place, one far off
    at = points(36, 5, 1.5) | {36: (-41.0, 174.0), 37: (-41.0, 174.0), 38: (None, 174.0), 39: (60.0, -10.0)}
    rows = [(i, *p) for i, p in at.items()] + [(37, -41.0, 174.0)]
    nodes = spark.createDataFrame(rows, "node_id long, lat double, lon double")
    have = [(i, i + 1) for i in range(0, 36, 2)] + [(5, 0), (3, None)]
    got = graph.stitch_edges(nodes, spark.createDataFrame(have, "src long, dst long"))
    near = lambda p, q: None not in (*p, *q) and math.dist(p, q) <= 20 / 111
    want = sorted((i, j) for i, *p in rows for j, *q in rows if i < j and near(p, q) and (i, j) not in have)
    assert sorted((r.src, r.dst) for r in got.collect()) == want and want.count((36, 37)) == 2
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_parts(spark):
    roads = spark.sql("SELECT 1L AS road_id, 50D AS free_flow_speed, 2D AS traffic_volume, array(array(struct(1D AS lon, 2D AS lat), struct(3D AS lon, 4D AS lat)), array(struct(9D AS lon, 9D AS lat), struct(8D AS lon, 8D AS lat))) AS parts")
    assert graph.polyline_segments(graph.explode_parts(roads)).count() == 2  # no segment across the gap


def test_gaps(spark):
    at = {1: (-41.0, 174.0), 2: (-41.0, 174.5), 3: (-41.0, 175.0), 4: (-41.0, 176.0), 5: (-41.0, 177.5)}
    routes = spark.createDataFrame([(7, 8, [1, 2, 3, 4, 5])], "origin long, dest long, path array<long>")
    near = spark.createDataFrame([(2, "stop")], "node_id long, facility_name string")
    got = gaps.distance_since_facility(routes, frame(spark, at), near).orderBy("seq").collect()
    assert [r.node_id for r in got] == [1, 2, 3, 4]
    assert [r.distance_km for r in got] == pytest.approx([0, 0, km(at[3], at[4]), km(at[3], at[4]) + km(at[4], at[5])])
    assert [r.facility_name for r in got] == ["stop"] * 4


def test_gap_ranking(spark):
    rows = [(1, 10, 1, 0, 90.0, "x"), (1, 10, 5, 0, 90.0, "y"), (1, 99, 98, 0, 80.0, "z"), (2, 10, 1, 0, 10.0, "x")]
    distances = spark.createDataFrame(rows, "node_id long, origin long, dest long, seq int, distance_km double, facility_name string")
    people = spark.createDataFrame([(10, 10), (1, 1), (5, 5), (99, 99)], "town_id long, population long")
    got = gaps.ranked_gaps(distances, people, 75).collect()
    assert [(r.node_id, r.facility_name, r.dest_population) for r in got] == [(1, "y", 5)]


def test_neighbors(spark):
    rows = [(1, -41.0, 174.0, 10.0, 1.0, 5.0), (2, -41.0, 174.1, 20.0, None, 7.0), (3, -41.0, 174.0, 30.0, 3.0, 9.0), (4, -45.0, 170.0, 1.0, 1.0, 1.0)]
    stations = spark.createDataFrame(rows, "station_id long, lat double, lon double, population_estimate double, traffic_volume double, free_flow_speed double")
    got = {r.station_id: r for r in spatial.neighbor_stats(stations, Params()).collect()}
    assert (got[1].neighbors, got[1].mean_population_estimate, got[1].mean_traffic_volume) == (1, 20.0, None)
    assert (got[2].neighbors, got[2].mean_traffic_volume) == (2, 2.0) and (got[4].neighbors, got[4].mean_distance_km) == (0, None)
