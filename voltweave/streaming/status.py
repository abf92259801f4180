"""Structured Streaming over the status log: windowed counts and stateful plug-in detection."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import OCCUPIED

PLUGINS = "station_id long, site_id long, ts timestamp_ntz"


def hourly_counts(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Status rows in each hour; rows later than ``late`` are left out once their hour has been closed."""
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", "1 hour").alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour_start"), "status", "n")


def plugin_stream(log: DataFrame) -> DataFrame:
    """Changes to Occupied, by a state of each station's last status.

    Rows of a micro-batch are taken in time order; a row that is not newer than
    the last one seen of its station, however late, does not change what was sent.
    The state is one row a station and stays, as the next row is compared with it
    whenever it comes; there is no watermark.
    """

    def detect(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last_ts, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"]).drop_duplicates("ts", keep="last")
        if last_ts is not None:
            rows = rows[rows["ts"] > pd.Timestamp(last_ts, unit="us")]
        out = []
        for site, ts, status in zip(rows["site_id"], rows["ts"], rows["status"]):
            if status == OCCUPIED and last != OCCUPIED:
                out.append((key[0], site, ts))
            last, last_ts = status, int(ts.value // 1000)
        if last_ts is not None:
            state.update((last_ts, last))
        yield pd.DataFrame(out, columns=["station_id", "site_id", "ts"])

    keyed = log.select("station_id", "site_id", "event_id", "ts", "status").groupBy("station_id")
    return keyed.applyInPandasWithState(detect, PLUGINS, "last_us long, last string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Process what there is, exactly once, and return it.  ``path`` must be shared by all executors.

    Each micro-batch writes a folder of its own number, so a repeated batch
    replaces its rows; in complete mode the last batch is the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*")
