"""Helpers shared by the training-data operators.

Shared storage: intermediate tables and files go below the folder named by
``spark.checkpoint.dir``, which every executor can read.  Only where that
setting is absent and the master is local (unit tests, notebooks) a temporary
folder is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.staging import drop, plain, shared_dir, stage

__all__ = ["WORD", "drop", "filesystem", "grow", "new_path", "plain", "publish", "rows", "settle", "shared_dir", "shrink", "stage"]

#: Regular expression of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(spark: SparkSession) -> None:
    """Let the executors' JVMs collect and give back what the steps before took, before Python workers need it.

    A heap that joins have filled stays at its largest size otherwise, and the workers' memory comes on top.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name, write) -> str:
    """Write a file under a name of this attempt, then move it to its own name (a text, or a function that is called after writing).

    A retried or speculative task writes the same bytes, so whichever attempt
    moves last leaves a whole file.
    """
    files, folder = filesystem(uri)
    files.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        write(out)
    name = name() if callable(name) else name
    files.move(temporary, f"{folder}/{name}")
    return f"{uri.rstrip('/')}/{name}"


def rows(batches: Iterator[pa.RecordBatch], text: int, most: int = 2_000_000) -> Iterator[tuple]:
    """Lists of columns' values, split so that a list's texts hold about ``most`` bytes.

    ``text`` is the index of the text column.  A longer single text comes alone.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield tuple(c.to_pylist() for c in batch.slice(at, to - at).columns)
            at = to


def shrink(numbers) -> bytes:
    """Unsigned 64-bit numbers, bytes of one place together, compressed."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def grow(data: bytes):
    """The numbers of shrink()."""
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").reshape(-1)
