"""Tables that are written once and read again, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Least time between two collections.
COLLECT_SECONDS = 5.0
_collected = float("-inf")


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below spark.checkpoint.dir.

    Where that is unset a local master gets a temporary folder; on a cluster the
    driver's and the executors' folders would differ, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="voltweave-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        root = _own[app]
    return f"{root.rstrip('/')}/voltweave-{app}"


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, whose ``columns`` (paths in Parquet) stage() writes without a dictionary: it makes hashes no smaller and costs time."""
    df._plain = columns
    return df


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage is cut and its rows are computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in getattr(df, "_plain", ())}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*staged: DataFrame | None) -> None:
    """Delete tables that stage() returned and that nothing reads any more; others are left alone.

    A collection in the driver's JVM after it, every few seconds at most, lets Spark's cleaner remove the shuffle files of
    the steps that are done.
    """
    global _collected
    spark = None
    for df in staged:
        if path := getattr(df, "_staged_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if spark is not None and time.monotonic() - _collected > COLLECT_SECONDS:
        spark._jvm.System.gc()
        _collected = time.monotonic()
