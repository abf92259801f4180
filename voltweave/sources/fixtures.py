"""The driver's tables as the logical tables, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Geometric part of a key: distinct primes scatter positions over the country.
LAT, LON = (7919, 0), (104729, 0)


def position(key: Column, lat: tuple[int, int] = LAT, lon: tuple[int, int] = LON) -> tuple[Column, Column]:
    key = key.cast("long")
    y = F.lit(-46.0) + ((key * lat[0] + lat[1]) % 12000) / F.lit(1000.0)
    x = F.lit(167.0) + ((key * lon[0] + lon[1]) % 11000) / F.lit(1000.0)
    return y.alias("lat"), x.alias("lon")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet").select(*columns)

    def availabilities(self) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind.isin("click", "purchase"), "Occupied").when(kind == "error", "Unavailable").otherwise("Available")
        user = F.col("user_id")
        return self.table("events", "event_id", "user_id", "ts", "event_type").select("event_id", user.alias("station_id"), F.expr("user_id div 3").alias("site_id"), "ts", status.alias("status"))

    def stations(self) -> DataFrame:
        ids = self.table("events", "user_id").distinct().select(F.col("user_id").alias("station_id"), F.expr("user_id div 3").alias("site_id"))
        turn = F.col("station_id") % 3
        lat, lon = position(F.col("site_id") * 29, (7907, 4321), (104723, 1234))
        return ids.select(
            "station_id",
            "site_id",
            F.concat(F.lit("Station "), F.col("station_id").cast("string")).alias("name"),
            (lat + turn * F.lit(0.05)).alias("lat"),
            lon,
            F.when(turn == 0, 25.0).when(turn == 1, 50.0).otherwise(150.0).alias("kw_rated"),
            F.when(F.col("station_id") % 11 == 10, "Planned").otherwise("Commissioned").alias("installation_status"),
            (F.col("station_id") % 17 == 16).cast("int").alias("provider_deleted"),
        )

    def sites(self) -> DataFrame:
        ids = self.table("events", "user_id").select(F.expr("user_id div 3").alias("site_id")).distinct()
        return ids.select("site_id", (F.col("site_id") % 13 == 12).cast("int").alias("provider_deleted"))

    def nodes(self) -> DataFrame:
        part = self.table("part", "p_partkey", "p_size")
        size = F.col("p_size").cast("double")
        return part.select(F.col("p_partkey").alias("node_id"), *position(F.col("p_partkey")), (size * 200).alias("traffic_volume"), (size + 50).alias("free_flow_speed"))

    def towns(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier", "s_suppkey", "s_name").select(s.alias("town_id"), F.col("s_name").alias("name"), *position(s * 13 + 5), (F.lit(1000) + (s * 379) % 9000).alias("population"))

    def hubs(self) -> DataFrame:
        n = F.col("n_nationkey").cast("long")
        return self.table("nation", "n_nationkey", "n_name").select(n.alias("hub_id"), F.col("n_name").alias("name"), *position(n * 31 + 7))

    def areas(self) -> DataFrame:
        n = F.col("n_nationkey").cast("long")
        base = self.table("nation", "n_nationkey", "n_name").select(n.alias("area_id"), F.col("n_name").alias("name"), *position(n * 17 + 3), (F.lit(1000) + n * 111).cast("double").alias("population_estimate"))
        return base.withColumn("year", F.explode(F.array(F.lit(2023), F.lit(2024))))

    def vertices(self) -> DataFrame:
        """Vertices of polylines in their order: road_id, seq, lat, lon, free_flow_speed, traffic_volume."""
        line = self.table("lineitem", "l_orderkey", "l_linenumber", "l_partkey")
        seq = (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("seq")
        key = F.col("l_orderkey")
        return line.select(key.alias("road_id"), seq, *position(F.col("l_partkey")), (F.lit(50) + key % 50).cast("double").alias("free_flow_speed"), ((key % 97) * 100).cast("double").alias("traffic_volume"))

    def sparse_edges(self) -> DataFrame:
        """Edges between some of the nodes; every fourth has none."""
        ids = self.table("part", "p_partkey").select(F.col("p_partkey").alias("node_id"))
        pairs = ids.filter("node_id % 4 in (0, 1)").select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
        return pairs.join(ids, F.col("dst") == F.col("node_id"), "left_semi")

    def _ring(self) -> tuple[DataFrame, int]:
        ids = self.table("supplier", "s_suppkey").select(F.col("s_suppkey").alias("i"))
        return ids, ids.count()

    def graph_nodes(self) -> DataFrame:
        ids, _ = self._ring()
        return ids.select(F.col("i").alias("node_id"), *position(F.col("i")))

    def _edges(self, pairs: DataFrame) -> DataFrame:
        from ..functions.geo import haversine

        i, j = F.least("i", "j"), F.greatest("i", "j")
        pairs = pairs.filter("i <> j").select(i.alias("src"), j.alias("dst"), (F.lit(50) + F.col("i") % 50).alias("speed"))
        pairs = pairs.groupBy("src", "dst").agg(F.max("speed").alias("speed"))
        (la, lo), (lb, lob) = position(F.col("src")), position(F.col("dst"))
        length = haversine(la, lo, lb, lob)
        return pairs.select("src", "dst", length.alias("length"), (length / F.col("speed")).alias("time"))

    def connected_edges(self) -> DataFrame:
        ids, n = self._ring()
        ids = ids.filter("i % 10 <> 0")
        return self._edges(ids.select("i", F.explode(F.array((F.col("i") + 1) % n, (F.col("i") * 7 + 3) % n)).alias("j")))

    def block_edges(self) -> DataFrame:
        """Blocks of five that are not connected with each other."""
        ids, n = self._ring()
        base = F.expr("5 * (i div 5)")
        pairs = ids.filter("i % 5 <> 4").select("i", F.explode(F.array(F.col("i") + 1, base + (F.col("i") * 2 + 1) % 5)).alias("j"))
        return self._edges(pairs.filter(F.col("j") < n))
