"""Readers and writers of files; every schema is given, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import DEFAULTS, Params
from ..functions.geo import first_vertex, island, ring_centroid, unproject
from . import schemas


class Datasets:
    """Named datasets below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, suffix: str = "parquet") -> str:
        return f"{self.root}/{name}.{suffix}"

    def find(self, ending: str) -> str | None:
        """Path of the first file, by name, whose name ends with ``ending``; None if there is none."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in (files.listStatus(root) if files.exists(root) else ()))
        return next((f"{self.root}/{n}" for n in names if n.endswith(ending)), None)

    def parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def csv(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).csv(self.path(name, "csv"), header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def populated_places(raw: DataFrame, threshold: int = DEFAULTS.population_threshold) -> DataFrame:
    """Populated places over a threshold from rows that hold a ``geonames`` array."""
    place = raw.select(F.explode("geonames").alias("p")).select("p.*")
    wanted = (F.coalesce("population", F.lit(0)) > threshold) & (F.col("fcl") == "P")
    return place.filter(wanted).select("name", F.col("lat").cast("double"), F.col("lng").cast("double").alias("lon"), "population")


def read_places(spark: SparkSession, path: str, threshold: int = DEFAULTS.population_threshold) -> DataFrame:
    """A stored response of a gazetteer service (JSON)."""
    return populated_places(spark.read.schema(schemas.GEONAMES).json(path, multiLine=True), threshold)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **properties: str) -> DataFrame:
    """A database table, in parallel by ranges of ``key`` if bounds are given; filters are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def active_stations(stations: DataFrame, sites: DataFrame) -> DataFrame:
    """Commissioned stations of sites; neither deleted (a null flag counts as unknown and is left out)."""
    kept = sites.filter(F.col("provider_deleted") != 1).select("site_id")
    return stations.filter((F.col("provider_deleted") != 1) & (F.col("installation_status") == "Commissioned")).join(kept, "site_id")


def availability_scan(log: DataFrame, stations: DataFrame, sites: DataFrame, start: str, stop: str, params: Params = DEFAULTS) -> DataFrame:
    """Log rows in [start, stop) of stations and sites that are not deleted, with local time."""
    kept = stations.filter("provider_deleted = 0").select("station_id", "site_id").join(sites.filter("provider_deleted = 0").select("site_id"), "site_id")
    window = (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(stop).cast("timestamp_ntz"))
    return log.filter(window).drop("site_id").join(kept, "station_id").withColumn("local_ts", local_time(F.col("ts"), params.zone))


def local_time(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


class _Table(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def wkb_points(blob: bytes) -> list[list[tuple[float, float]]]:
    """Parts of (x, y) vertices of a WKB or GeoPackage geometry (point, line, polygon or multi of these)."""
    import struct

    at = 0
    if blob[:2] == b"GP":  # header: magic, version, flags, srs, envelope
        at = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]

    def shape(at: int) -> tuple[list, int]:
        order = "<" if blob[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", blob, at + 1)
        extra = (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3) + (kind >> 31 & 1) + (kind >> 30 & 1)
        kind, at, wide = (kind & 0xFFFFFFF) % 1000, at + 5, 2 + extra

        def points(n: int, at: int) -> tuple[list, int]:
            flat = struct.unpack_from(f"{order}{n * wide}d", blob, at)
            return [(flat[k], flat[k + 1]) for k in range(0, n * wide, wide)], at + 8 * n * wide

        if kind == 1:
            part, at = points(1, at)
            return [part], at
        (n,) = struct.unpack_from(order + "I", blob, at)
        at += 4
        if kind == 2:
            part, at = points(n, at)
            return [part], at
        parts = []
        for _ in range(n):
            if kind == 3:
                (m,) = struct.unpack_from(order + "I", blob, at)
                part, at = points(m, at + 4)
                parts.append(part)
            else:
                more, at = shape(at)
                parts += more
        return parts, at

    return shape(at)[0]


class GeoPackageReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[_Table]:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            (top,) = db.execute(f'SELECT coalesce(max(rowid), 0) FROM "{self.options["table"]}"').fetchone()
        step = max(1, -(-(top + 1) // int(self.options.get("numpartitions", 8))))
        return [_Table(k, k + step) for k in range(0, top + 1, step)]

    def read(self, partition: _Table) -> Iterator[tuple]:
        import sqlite3

        geometry = self.options.get("geometry", "geom")
        names = [f.name for f in self.schema.fields if f.name != "parts"]
        listed = ", ".join(f'"{n}"' for n in [geometry, *names])
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT {listed} FROM "{self.options["table"]}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high)):
                own = dict(zip(names, row[1:]))
                own["parts"] = [[{"lon": x, "lat": y} for x, y in part] for part in wkb_points(row[0])] if row[0] else None
                yield tuple(own[f.name] for f in self.schema.fields)


class GeoPackageSource(DataSource):
    """spark.read.format("voltweave_gpkg").schema(...).option("table", ...).load(path).

    ``parts`` in the schema takes the geometry's vertices.  The file must be at
    the same path on every machine (a mounted share).
    """

    @classmethod
    def name(cls) -> str:
        return "voltweave_gpkg"

    def schema(self) -> str:
        return "parts array<array<struct<lon: double, lat: double>>>"

    def reader(self, schema) -> GeoPackageReader:
        return GeoPackageReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_geopackage(spark: SparkSession, path: str, table: str, schema: str, **options) -> DataFrame:
    spark.dataSource.register(GeoPackageSource)
    return spark.read.format("voltweave_gpkg").schema(schema).options(table=table, **options).load(path)


def _degrees(parts: Column, epsg: int | None) -> Column:
    """Vertices in degrees of parts in a projection (none: they are in degrees)."""
    if epsg is None:
        return parts

    def vertex(v: Column) -> Column:
        lat, lon = unproject(v["lon"], v["lat"], epsg)  # easting and northing
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.transform(parts, lambda part: F.transform(part, vertex))


def _largest(parts: Column) -> Column:
    """The part of most vertices: the outer ring of the main polygon."""
    return F.element_at(F.array_sort(parts, lambda a, b: F.size(b) - F.size(a)), 1)


def read_hubs(spark: SparkSession, path: str, table: str, key: str, name: str, epsg: int | None = 2193, **options) -> DataFrame:
    """hub_id, name, lat, lon, island of polygons or points in a GeoPackage, by their centroids."""
    raw = read_geopackage(spark, path, table, f"`{key}` long, `{name}` string, parts array<array<struct<lon: double, lat: double>>>", **options)
    lon, lat = ring_centroid(_largest(_degrees(F.col("parts"), epsg)))
    placed = raw.filter("parts is not null").select(F.col(key).alias("hub_id"), F.col(name).alias("name"), lat.alias("lat"), lon.alias("lon"))
    return placed.withColumn("island", island(F.col("lon"), F.col("lat")))


def read_highways(spark: SparkSession, path: str, table: str, key: str, speed: str, volume: str, epsg: int | None = 2193, **options) -> DataFrame:
    """road_id, parts (in degrees), free_flow_speed, traffic_volume, island (by the first vertex) of lines in a GeoPackage."""
    raw = read_geopackage(spark, path, table, f"`{key}` long, `{speed}` double, `{volume}` double, parts array<array<struct<lon: double, lat: double>>>", **options)
    lines = raw.filter("parts is not null").select(F.col(key).alias("road_id"), _degrees(F.col("parts"), epsg).alias("parts"), F.col(speed).alias("free_flow_speed"), F.col(volume).alias("traffic_volume"))
    first = first_vertex(F.col("parts"))
    return lines.withColumn("island", island(first["lon"], first["lat"]))


def read_areas(spark: SparkSession, path: str, table: str, key: str, name: str, year: str, people: str, epsg: int | None = 2193, **options) -> DataFrame:
    """area_id, name, year, population_estimate, lat, lon of areas in a GeoPackage, by their centroids."""
    raw = read_geopackage(spark, path, table, f"`{key}` long, `{name}` string, `{year}` int, `{people}` double, parts array<array<struct<lon: double, lat: double>>>", **options)
    lon, lat = ring_centroid(_largest(_degrees(F.col("parts"), epsg)))
    return raw.filter("parts is not null").select(F.col(key).alias("area_id"), F.col(name).alias("name"), F.col(year).alias("year"), F.col(people).alias("population_estimate"), lat.alias("lat"), lon.alias("lon"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, data; edges: source, target, data) of a GraphML file; data maps key to text."""
    item = "data array<struct<_key: string, _VALUE: string>>"

    def table(tag: str, attributes: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(f"{attributes}, {item}").load(path)

    values = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key: string, _VALUE: string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    nodes = table("node", "_id string").select(F.col("_id").alias("node"), values.alias("data"))
    edges = table("edge", "_source string, _target string").select(F.col("_source").alias("source"), F.col("_target").alias("target"), values.alias("data"))
    return nodes, edges


def write_by_island(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder for each island; an earlier output is replaced."""
    writer = df.write.mode("overwrite").partitionBy("island")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def load_or_create_graph(spark: SparkSession, path: str, create) -> tuple[DataFrame, DataFrame]:
    """The graph stored at ``path``; it is made and stored first if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return read_graph(spark, path)
    except AnalysisException:
        write_graph(*create(), path)
        return read_graph(spark, path)


def _features(df: DataFrame, kind: str, coordinates: Column, properties: tuple[str, ...]) -> DataFrame:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    own = F.struct(*properties) if properties else F.create_map().cast("map<string,string>")
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), own.alias("properties"))).alias("feature"))


def geojson_features(df: DataFrame, *properties: str) -> DataFrame:
    """One GeoJSON feature (text) for each row with lat and lon."""
    return _features(df, "Point", F.array("lon", "lat"), properties)


def geojson_lines(df: DataFrame, *properties: str, line: str = "line") -> DataFrame:
    """One GeoJSON line for each row with an array of [lon, lat], as graph.route_geometry gives it."""
    return _features(df, "LineString", F.col(line), properties)


def geojson_polygons(df: DataFrame, *properties: str, parts: str = "parts") -> DataFrame:
    """One GeoJSON polygon for each row with rings of structs (lon, lat); each ring is closed."""
    closed = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    rings = F.transform(parts, lambda r: F.transform(closed(r), lambda v: F.array(v["lon"], v["lat"])))
    return _features(df, "Polygon", rings, properties)
