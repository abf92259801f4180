"""Token-id files that are read by document (operator 10).

A file is a row of independent zstandard frames, each with its content checksum,
followed by two skippable frames: an index (first row of each frame) and, last,
the seek table of the public zstandard seekable format with the sizes and the
checksum (low 32 bits of XXH64) of every frame.  A reader takes the seek table
from the file's end and decompresses only the frames that hold what it wants.

A frame's content: u32 number of documents n, n x i64 doc_id, n x u8 (1: doc_id is
null), n x u64 tokens, then all ids as u32; everything little-endian.

Documents are range-partitioned by (doc_id, hash of the text), so a repeated
doc_id does not meet in one task; null doc_ids come first.  Every task writes one
file, under a temporary name that is moved to the file's own name at its end, so
a repeated attempt replaces the file by the same bytes.

Defined cases: null or empty text: the end token alone.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, new_path, publish, rows, stage
from .tokenize import default_tokenizer, encoder

#: Fixed values of the zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: A frame is closed when it holds this many ids; a longer document has one alone.
FRAME_IDS = 1 << 16
END = 2


class Writer:
    def __init__(self, out, level: int = 1):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.docs: list = []
        self.ids: list[np.ndarray] = []
        self.held = self.rows = self.tokens = 0
        self.table: list[tuple[int, int, int]] = []
        self.first: list[int] = []

    def add(self, doc, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > FRAME_IDS:
            self.flush()
        self.docs.append(doc)
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        import xxhash

        if not self.docs:
            return
        n = len(self.docs)
        raw = b"".join(
            [
                struct.pack("<I", n),
                np.array([d or 0 for d in self.docs], "<i8").tobytes(),
                np.array([d is None for d in self.docs], "u1").tobytes(),
                np.array([len(x) for x in self.ids], "<u8").tobytes(),
                np.concatenate(self.ids).astype("<u4").tobytes(),
            ]
        )
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.first.append(self.rows)
        self.rows += n
        self.tokens += self.held
        self.docs, self.ids, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        index = struct.pack("<Q", self.rows) + np.array(self.first, "<u8").tobytes()
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class Reader:
    """Random access to a file by frame, row or doc_id."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        frames, flag, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE or flag != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * frames - 8
        self.table = list(struct.iter_unpack("<III", self.at(start + 8, 12 * frames)))
        self.offsets = np.concatenate([[0], np.cumsum([t[0] for t in self.table], dtype=np.int64)]) if frames else np.zeros(1, np.int64)
        index = self.at(int(self.offsets[-1]) + 8, 8 + 8 * frames)
        self.rows, self.first = struct.unpack_from("<Q", index)[0], np.frombuffer(index, "<u8", offset=8)

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, i: int) -> list[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of each document of frame i, after its checksum was verified."""
        import xxhash

        packed, size, check = self.table[i]
        raw = self.zstd.decompress(self.at(int(self.offsets[i]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not match its checksum")
        (n,) = struct.unpack_from("<I", raw)
        docs, null, sizes = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "u1", n, 4 + 8 * n), np.frombuffer(raw, "<u8", n, 4 + 9 * n)
        ids, edge = np.frombuffer(raw, "<u4", offset=4 + 17 * n), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return [(None if null[k] else int(docs[k]), ids[edge[k] : edge[k + 1]]) for k in range(n)]

    def row(self, k: int) -> tuple[int | None, np.ndarray]:
        i = int(np.searchsorted(self.first, k, side="right")) - 1
        return self.frame(i)[k - int(self.first[i])]

    def find(self, doc: int) -> list[np.ndarray]:
        """Ids of the documents with this doc_id; rows are in ascending order, so few frames are opened."""
        low, high = 0, len(self.table)
        while low < high:  # first frame whose last doc_id is not below
            mid = (low + high) // 2
            last = self.frame(mid)[-1][0]
            low, high = (mid + 1, high) if last is None or last < doc else (low, mid)
        found = []
        while low < len(self.table) and (rows := self.frame(low)) and (rows[0][0] is None or rows[0][0] <= doc):
            found += [ids for d, ids in rows if d == doc]
            low += 1
        return found


def write(documents: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Write all documents in ascending doc_id order below ``folder``.

    Returns one row for each file: part, path, n_docs, n_tokens (staged, so the files are there).
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, counts = TaskContext.get().partitionId(), []

        def fill(out) -> None:
            writer = Writer(out)
            for docs, texts in rows(batches, 1):
                ids, sizes = encoder(path).encode(texts, end)
                at = 0
                for doc, n in zip(docs, sizes.tolist()):
                    writer.add(doc, ids[at : at + n])
                    at += n
            writer.close()
            counts.extend((writer.rows, writer.tokens))

        name = publish(folder, f"part-{part:06d}.ids.zst", fill)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([counts[0]], pa.int64()), pa.array([counts[1]], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stage(ordered.mapInArrow(run, "part int, path string, n_docs long, n_tokens long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """One row for each document of ``files`` (from write): doc_id, start, n_tokens, ids_crc32."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    plan = files.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    plan = plan.repartition(max(1, files.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, local = filesystem(name)
                with fs.open_input_file(local) as file:
                    reader = Reader(file, file.size())
                    for i in range(len(reader.table)):
                        docs = reader.frame(i)
                        sizes = [len(ids) for _, ids in docs]
                        starts = at + np.concatenate([[0], np.cumsum(sizes)])
                        at = int(starts[-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in docs], pa.int64()), pa.array(starts[:-1].astype(np.int64)), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(ids.tobytes()) for _, ids in docs], pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read(write(documents, new_path(documents.sparkSession, "ids"), tokenizer))
