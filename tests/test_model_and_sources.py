import json
import math
import os
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltweave.functions import money
from voltweave.operators import model, simulation, timeline
from voltweave.sources import readers, schemas


def test_features(spark):
    rows = [(1, "b", 1.0, None, 2.0), (2, "a", None, None, 3.0), (3, None, 3.0, None, 4.0), (4, "a", 5.0, None, None)]
    df = spark.createDataFrame(rows, "id long, kind string, x double, nothing double, y double")
    got = [tuple(r) for r in model.feature_matrix(df, ["kind", "x", "nothing"], "y", "id").orderBy("id").collect()]
    assert got == [(1, 1.0, 1.0, 2.0), (2, 0.0, 2.0, 3.0), (3, 0.5, 3.0, 4.0)]
    assert model.feature_matrix(df, ["kind", "x", "nothing"], "y", "id", impute=False).count() == 1


def data(spark, n=400):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    y = x @ [2.0, -1.0, 0.0] + 5 + rng.normal(size=n) * 0.1
    return x, y, spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")


def test_ridge_equals_the_closed_form(spark):
    x, y, df = data(spark)
    fit = model.ridge_cv(df, ["a", "b", "c"], "y", "id")
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + fit.alpha * np.eye(3), xc.T @ yc)
    assert fit.weights == pytest.approx(want, abs=1e-8) and fit.cv_r2 > 0.99
    got = model.prediction_metrics(fit.predict(df), "y").first()
    assert got.r2 > 0.99 and got.r > 0.99
    assert [r.feature for r in model.top_predictors(spark, fit, 2).collect()] == ["a", "b"]
    lasso = model.elastic_net(df, ["a", "b", "c"], "y", 0.2)
    assert lasso.weights[2] == 0 and 1.6 < lasso.weights[0] < 2
    ridge = model.elastic_net(df, ["a", "b", "c"], "y", 0.5, l1_ratio=0.0)
    assert ridge.weights == pytest.approx(np.linalg.solve(xc.T @ xc / len(y) + 0.5 * np.eye(3), xc.T @ yc / len(y)), abs=1e-8)


def test_rate_is_recovered(spark):
    arrivals = simulation.simulate_arrivals(spark, days=365)
    assert arrivals.count() == pytest.approx(sum(simulation.RATE) * 24 * 365, rel=0.05)
    assert arrivals.count() == simulation.simulate_arrivals(spark, days=365).repartition(3).count()
    fit = simulation.fit_intensity(arrivals, 365)
    assert sum(fit) == pytest.approx(sum(simulation.RATE), rel=0.05)
    hours = np.linspace(0, 24, 50)
    value = lambda x: [x[0] + x[1] * (1 + math.sin(math.pi * h / 12)) + x[2] * (1 + math.sin(math.pi * h / 6)) + x[3] * (1 + math.cos(math.pi * h / 12)) + x[4] * (1 + math.cos(math.pi * h / 6)) for h in hours]
    assert np.abs(np.array(value(fit)) - value(simulation.RATE)).mean() < 0.05


def test_integral_has_a_closed_form(spark):
    x = simulation.RATE
    steps = spark.range(3000).select((F.lit(7.0) + (F.col("id") + 0.5) / 1000).alias("t"))
    numeric = steps.agg(F.sum(money.intensity(F.col("t"), x)) / 1000).first()[0]
    assert spark.range(1).select(money.intensity_integral(F.lit(10.0), 3.0, x)).first()[0] == pytest.approx(numeric, rel=1e-6)


def test_frequency():
    assert [money.frequency_hours(x) for x in ("10T", "2H", "D", "H")] == [pytest.approx(1 / 6), 2, 24, 1]
    with pytest.raises(ValueError):
        money.frequency_hours("3X")


def test_places(spark, tmp_path):
    body = {"geonames": [{"name": "A", "lat": "-41", "lng": "174", "population": 3000, "fcl": "P"}, {"name": "B", "lat": "-41", "lng": "174", "population": 2000, "fcl": "P"}, {"name": "C", "lat": "-41", "lng": "174", "population": 9000, "fcl": "A"}, {"name": "D", "lat": "-41", "lng": "174", "fcl": "P"}]}
    (tmp_path / "places.json").write_text(json.dumps(body))
    assert [r.name for r in readers.read_places(spark, str(tmp_path / "places.json")).collect()] == ["A"]


def test_null_flags_are_left_out(spark):
    stations = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 50.0, "Commissioned", 0), (2, 1, "b", 0.0, 0.0, 50.0, "Commissioned", None), (3, 2, "c", 0.0, 0.0, 50.0, "Commissioned", 0), (4, 1, "d", 0.0, 0.0, 50.0, "Planned", 0)], schemas.STATIONS)
    sites = spark.createDataFrame([(1, 0), (2, 1)], schemas.SITES)
    assert [r.station_id for r in readers.active_stations(stations, sites).collect()] == [1]


def wkb(kind, *points):
    body = b"".join(struct.pack("<dd", *p) for p in points)
    return struct.pack("<BI", 1, kind) + (b"" if kind == 1 else struct.pack("<I", len(points))) + body


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "roads.gpkg")
    lines = [wkb(2, (1, 2), (3, 4)), struct.pack("<BII", 1, 5, 2) + wkb(2, (1, 2), (3, 4)) + wkb(2, (5, 6), (7, 8)), wkb(1, (9, 9)), None]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom BLOB, speed REAL)")
        db.executemany("INSERT INTO roads (geom, speed) VALUES (?, ?)", [(g and b"GP\0\1\0\0\0\0" + g, 50.0 + i) for i, g in enumerate(lines)])
    df = readers.read_geopackage(spark, path, "roads", "fid long, parts array<array<struct<lon: double, lat: double>>>, speed double", numPartitions=2)
    got = {r.fid: r for r in df.collect()}
    assert [[tuple(v) for v in p] for p in got[2].parts] == [[(1, 2), (3, 4)], [(5, 6), (7, 8)]]
    assert len(got) == 4 and got[4].parts is None and got[3].speed == 52 and tuple(got[3].parts[0][0]) == (9, 9)


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.0, 0.0)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 1.0, 1.0)], schemas.EDGES)
    made = []
    for _ in range(2):
        got = readers.load_or_create_graph(spark, str(tmp_path / "g"), lambda: made.append(1) or (nodes, edges))
        assert got[0].count() == 1 and got[1].count() == 1
    assert made == [1]
    readers.write_by_island(nodes.withColumn("island", F.lit("North")), str(tmp_path / "out"), "csv")
    assert readers.read_csv(spark, str(tmp_path / "out" / "island=North"), "node_id long, lat double, lon double").count() == 1
    feature = json.loads(readers.geojson_features(nodes, "node_id").first().feature)
    assert feature["geometry"]["coordinates"] == [0, 0] and feature["properties"] == {"node_id": 1}


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><graph edgedefault="undirected"><node id="(-41.1, 174.2)"><data key="d0">5</data></node><node id="b"/><edge source="(-41.1, 174.2)" target="b"><data key="d1">1.5</data></edge></graph></graphml>')
    nodes, edges = readers.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.node: r.data for r in nodes.collect()} == {"(-41.1, 174.2)": {"d0": "5"}, "b": {}}
    assert [(r.source, r.target, r.data) for r in edges.collect()] == [("(-41.1, 174.2)", "b", {"d1": "1.5"})]


def test_ridge_learns_from_training_rows_alone(spark):
    """The query against plain numpy: numbers of texts, means, deviations and alpha come from the training rows."""
    import hashlib

    import xxhash

    from voltweave.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_size", "p_retailprice", "p_brand", "p_type").collect()
    rows = [r for r in rows if r.p_partkey % 11]
    test = np.array([int(hashlib.md5(str(r.p_partkey).encode()).hexdigest()[:8], 16) % 5 == 0 for r in rows])
    train = [r for r, t in zip(rows, test) if not t]
    numbers = [{v: i for i, v in enumerate(sorted({r[c] for r in train}))} for c in ("p_brand", "p_type")]
    x = np.array([[r.p_size, r.p_retailprice if r.p_partkey % 7 else np.nan, numbers[0].get(r.p_brand, np.nan), numbers[1].get(r.p_type, np.nan)] for r in rows], float)
    y = np.array([r.p_size * 2 + r.p_partkey % 13 for r in rows], float)
    x = np.where(np.isnan(x), np.nanmean(x[~test], axis=0), x)
    x = (x - x[~test].mean(axis=0)) / x[~test].std(axis=0)
    fold = np.array([(lambda h: (h - (1 << 64) if h >> 63 else h) % 10)(xxhash.xxh64_intdigest(str(r.p_partkey).encode(), 42)) for r in rows])

    def solve(a, b, alpha):
        m, n = a.mean(axis=0), b.mean()
        w = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(4), (a - m).T @ (b - n))
        return w, n - m @ w

    def r2(b, p):
        return 1 - ((b - p) ** 2).sum() / ((b - b.mean()) ** 2).sum()

    scores = []
    for alpha in model.ALPHAS:
        each = []
        for k in set(fold[~test]):
            inner, out = ~test & (fold != k), ~test & (fold == k)
            if out.sum() > 1:
                w, b = solve(x[inner], y[inner], alpha)
                each.append(r2(y[out], x[out] @ w + b))
        scores.append(np.mean(each))
    alpha = model.ALPHAS[int(np.argmax(scores))]
    w, b = solve(x[~test], y[~test], alpha)
    got = registry.QUERIES["ridge_metrics"](spark, folder).first()
    assert got.n == test.sum() and got.alpha == pytest.approx(alpha)
    assert got.r2 == pytest.approx(r2(y[test], x[test] @ w + b), abs=1e-9) and got.r == pytest.approx(np.corrcoef(y[test], x[test] @ w + b)[0, 1], abs=1e-9)


@pytest.mark.parametrize("ratio", [1.0, 0.5])
def test_lasso_and_elastic_net_by_folds(spark, ratio):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = x @ [3.0, 0.0, -1.0, 0.0] + rng.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double")
    fit = model.elastic_net_cv(df, ["a", "b", "c", "d"], "y", "id", ratio)
    assert fit.alpha in model.ALPHAS and fit.cv_r2 > 0.85
    centred, rest = x - x.mean(axis=0), y - x @ fit.weights - fit.intercept
    slope = centred.T @ rest / 300 - fit.alpha * (1 - ratio) * fit.weights  # at the optimum: alpha * ratio * sign, or less where the weight is zero
    for w, s in zip(fit.weights, slope):
        assert s == pytest.approx(fit.alpha * ratio * np.sign(w), abs=1e-8) if w else abs(s) <= fit.alpha * ratio + 1e-8
    one = model.elastic_net(df, ["a", "b", "c", "d"], "y", fit.alpha, ratio)
    assert one.weights == pytest.approx(fit.weights, abs=1e-9)


def test_dead_time_by_stretches(spark):
    rng = np.random.default_rng(9)
    rows = [(int(c), float(h)) for c in range(4) for h in np.sort(rng.uniform(0, 300, 40 + 200 * c))]
    want = []
    for c in range(4):
        last = -np.inf
        for k, h in rows:
            if k == c and h >= last + 3:
                want.append((c, h))
                last = h
    got = timeline.dead_time_filter(spark.createDataFrame(rows, "charger_id long, hour double"), 3.0).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from voltweave.plans import staging

    def session(master):
        conf = SimpleNamespace(get=lambda *a: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId=f"app-{master}", master=master, getConf=lambda: conf))

    assert staging.shared_dir(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError):
            staging.shared_dir(session(master))


def test_composed_sources(spark, tmp_path):
    from voltweave.functions import geo

    path = str(tmp_path / "all.gpkg")
    head = b"GP\0\1\0\0\0\0"
    square = [(1600000 + x, 5400000 + y) for x, y in ((-500, -500), (500, -500), (500, 500), (-500, 500), (-500, -500))]
    polygon = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<dd", *v) for v in square)
    with sqlite3.connect(path) as db:
        for table in ("hubs", "roads", "areas"):
            db.execute(f"CREATE TABLE {table} (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, speed REAL, volume REAL, year INTEGER)")
            shapes = [wkb(2, (1600000, 5400000), (1600100, 5400100)) if table == "roads" else polygon, None]
            db.executemany(f"INSERT INTO {table} (geom, name, speed, volume, year) VALUES (?, ?, ?, ?, ?)", [(g and head + g, f"n{i}", 50.0, 9.0, 2023) for i, g in enumerate(shapes)])
    lat, lon = spark.range(1).select(*geo.unproject(F.lit(1600000.0), F.lit(5400000.0), 2193)).first()
    hub = readers.read_hubs(spark, path, "hubs", "fid", "name").collect()
    assert [(h.hub_id, h.name, h.island) for h in hub] == [(1, "n0", "South")] and (hub[0].lat, hub[0].lon) == pytest.approx((lat, lon), abs=1e-6)
    road = readers.read_highways(spark, path, "roads", "fid", "speed", "volume").collect()
    assert len(road) == 1 and road[0].island == "South" and tuple(road[0].parts[0][0]) == pytest.approx((lon, lat), abs=1e-9) and road[0].free_flow_speed == 50
    area = readers.read_areas(spark, path, "areas", "fid", "name", "year", "speed").collect()
    assert len(area) == 1 and (area[0].year, area[0].population_estimate) == (2023, 50.0) and area[0].lat == pytest.approx(lat, abs=1e-6)


def test_layers_and_datasets(spark, tmp_path):
    lines = spark.sql("SELECT 1L AS origin, array(array(174D, -41D), array(175D, -40D)) AS line, array(array(struct(1D AS lon, 2D AS lat), struct(3D AS lon, 2D AS lat), struct(3D AS lon, 4D AS lat))) AS parts")
    line, polygon = (json.loads(f(lines, "origin").first().feature) for f in (readers.geojson_lines, readers.geojson_polygons))
    assert line["geometry"] == {"type": "LineString", "coordinates": [[174, -41], [175, -40]]} and line["properties"] == {"origin": 1}
    assert polygon["geometry"] == {"type": "Polygon", "coordinates": [[[1, 2], [3, 2], [3, 4], [1, 2]]]}
    for name in ("02_towns.csv", "01_towns.csv", "03_other.csv"):
        (tmp_path / name).write_text("a\n1\n")
    sets = readers.Datasets(spark, str(tmp_path))
    assert sets.find("_towns.csv") == f"{tmp_path}/01_towns.csv" and sets.find("none") is None
    assert sets.csv("03_other", "a int").first().a == 1
