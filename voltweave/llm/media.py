"""Media columns (operator 4): payloads as image samples in archives, read by a custom Spark data source.

Writing: each payload becomes an 8-bit greyscale PNG, 64 samples wide, whose
text chunk keeps the payload's unpadded size; PNGs are stored in plain ZIP
archives (no member is compressed twice).  Member names have a fixed length, so
the records of an archive's central directory have one too; how many there are is
part of the archive's name.

Reading: the data source plans its partitions as byte ranges of those archive
directories, from names and sizes in the folder's listing alone, a range for about
``partitionbytes`` of members; no archive is opened on the driver unless its name says
nothing.  A task reads its range of the directory, then its members, and yields Arrow
batches bounded in bytes.  A member that can't be read or fails its CRC is read again
by its own offset, without repeating the others.

Defined cases: null text counts as empty; every payload has at least 64 bytes; a text
of any length is one member (up to 4 GB, the format's bound); null doc_id stays null;
rows of one doc_id, and repeated rows, are members of their own in any order; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, new_path, publish, rows

WIDTH = 64
NAME = 20  # characters of a member's name: sign or "null", then digits
#: Fixed sizes of the ZIP format: central directory record without name, local header, end record.
CENTRAL, LOCAL, END = 46, 30, 22
RECORD = CENTRAL + NAME
#: An archive is closed before it reaches either bound, so 32-bit offsets and 16-bit counts hold.
MOST_BYTES, MOST_MEMBERS = 1 << 30, 60_000
PNG = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes, size: int) -> bytes:
    """PNG of one row for each 64 bytes of ``data``."""
    high = len(data) // WIDTH
    lines = np.zeros((high, WIDTH + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(high, WIDTH)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, high, 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"bytes\0%d" % size) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[bytes, int]:
    """(payload, unpadded size) of a PNG written by to_png."""
    if png[:8] != PNG:
        raise ValueError("no PNG")
    at, data, size, high = 8, [], 0, 0
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a chunk does not match its CRC")
        if kind == b"IHDR":
            high = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"tEXt":
            size = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, WIDTH + 1)
    return lines[:, 1:].tobytes(), size


def feature(data: bytes) -> str:
    """Mean and deviation of the samples, and a 16-bin histogram of their shares in 1/10000."""
    bins = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.int64)
    n, level = int(bins.sum()), np.arange(256)
    mean = int((bins * level).sum()) / n
    var = int((bins * level * level).sum()) / n - mean * mean
    share = bins.reshape(16, 16).sum(axis=1) * 10000 // n
    return f"{mean:.4f},{max(var, 0) ** 0.5:.4f}," + "-".join(map(str, share.tolist()))


class Archive:
    """A ZIP file of stored members with names of one length."""

    def __init__(self, out):
        self.out, self.at, self.records = out, 0, []

    def full(self, more: int) -> bool:
        return len(self.records) >= MOST_MEMBERS or self.at + more + LOCAL + NAME + RECORD * (len(self.records) + 1) > MOST_BYTES

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        fields = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, crc, len(data), len(data), len(raw), 0)  # stored, 1 January 1980
        self.records.append(b"PK\x01\x02" + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, self.at) + raw)
        self.out.write(b"PK\x03\x04" + fields + raw)
        self.out.write(data)
        self.at += LOCAL + len(raw) + len(data)

    def close(self) -> None:
        listed = b"".join(self.records)
        self.out.write(listed + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(self.records), len(self.records), len(listed), self.at, 0))


def write_archives(documents: DataFrame, folder: str) -> int:
    """Store every text as a PNG in archives below ``folder``; returns the number of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files, members = TaskContext.get().partitionId(), 0, 0
        docs = ((doc, to_png(*payload(text))) for ids, texts in rows(batches, 1) for doc, text in zip(ids, texts))
        held = next(docs, None)
        while held:

            def fill(out) -> None:
                nonlocal held, members
                archive = Archive(out)
                while held and not (archive.records and archive.full(len(held[1]))):
                    archive.add("null".ljust(NAME, "-") if held[0] is None else f"{held[0]:+0{NAME}d}", held[1])
                    members += 1
                    held = next(docs, None)
                archive.close()

            before = members
            publish(folder, lambda: f"part-{part:06d}-{files:04d}-m{members - before}.zip", fill)  # noqa: B023
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], ["n"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class Range(InputPartition):
    """Bytes ``start`` to ``stop`` of the directory in the archive at ``path``."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.batch = int(options.get("batchbytes", 8 << 20))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[Range]:
        from pyarrow.fs import FileSelector

        files, folder = filesystem(self.folder)
        out = []
        for info in sorted(files.get_file_info(FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
            if not info.base_name.endswith(".zip") or info.base_name.startswith("."):
                continue
            n, start = self.directory(files, info)
            step = max(1, n * self.bytes // max(1, start)) * RECORD
            out += [Range(f"{self.folder.rstrip('/')}/{info.base_name}", at, min(at + step, start + n * RECORD)) for at in range(start, start + n * RECORD, step)]
        return out or [Range("", 0, 0)]

    @staticmethod
    def directory(files, info) -> tuple[int, int]:
        """(records, start) of an archive's directory, from its name and size, or else from its end."""
        if named := re.search(r"-m(\d+)\.zip$", info.base_name):
            n = int(named[1])
            return n, info.size - END - n * RECORD
        with files.open_input_file(info.path) as file:
            file.seek(info.size - END)
            magic, _, _, _, n, size, start, _ = struct.unpack("<IHHHHIIH", file.read(END))
        if magic != 0x06054B50 or size != n * RECORD:
            raise ValueError(f"{info.path}: the directory has records of other sizes")
        return n, start

    def member(self, open_file, file, offset: int, size: int, crc: int) -> tuple[bytes, object]:
        """One member's bytes by its offset; after a fault the file is opened anew and only this member read again."""
        for left in reversed(range(self.tries)):
            try:
                file = file or open_file()
                file.seek(offset)
                head = file.read(LOCAL)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member at this offset")
                file.seek(offset + LOCAL + sum(struct.unpack_from("<HH", head, 26)))
                data = file.read(size)
                if len(data) != size or zlib.crc32(data) != crc:
                    raise OSError("a member does not match its CRC")
                return data, file
            except OSError:
                if not left:
                    raise
                file = None
                time.sleep(0.05 * (self.tries - left))
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        files, path = filesystem(partition.path)
        opened = lambda: files.open_input_file(path)
        file = opened()
        file.seek(partition.start)
        listed = file.read(partition.stop - partition.start)
        ids, offsets, data, held = [], [], [], 0
        for at in range(0, len(listed), RECORD):
            if listed[at : at + 4] != b"PK\x01\x02":
                raise ValueError(f"{partition.path}: no record of the directory at {partition.start + at}")
            crc, size = struct.unpack_from("<II", listed, at + 16)
            (offset,), name = struct.unpack_from("<I", listed, at + 42), listed[at + CENTRAL : at + RECORD].decode()
            member, file = self.member(opened, file, offset, size, crc)
            ids.append(None if name.startswith("null") else int(name))
            offsets.append(offset)
            data.append(member)
            held += size
            if held >= self.batch:
                yield self.rows(ids, offsets, data)
                ids, offsets, data, held = [], [], [], 0
        if ids:
            yield self.rows(ids, offsets, data)

    @staticmethod
    def rows(ids, offsets, data) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "member_offset", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("voltweave_archive").load(folder): doc_id, member_offset, media."""

    @classmethod
    def name(cls) -> str:
        return "voltweave_archive"

    def schema(self) -> str:
        return "doc_id long, member_offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("voltweave_archive").options(**options).load(folder)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Decode the media column and compute its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in FEATURES.split(", ")])
        for batch in batches:
            out = []
            for doc, png in zip(batch.column(0).to_pylist(), batch.column(1)):
                png = png.as_py()
                data, size = from_png(png)
                out.append((doc, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(kinds), kinds)], schema=kinds)

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def write_and_describe(documents: DataFrame) -> DataFrame:
    folder = new_path(documents.sparkSession, "media")
    write_archives(documents, folder)
    return describe(read_archives(documents.sparkSession, folder))
