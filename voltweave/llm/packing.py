"""Packing token sequences into windows (operator 8).

Each partition streams its documents.  Stretches of ``size`` tokens of a long
document fill a window alone; what is left of each document goes to a pool.
When the pool holds GROUP windows' worth of tokens, Karmarkar-Karp multiway
differencing spreads its pieces: every piece starts as a partition of k windows
of which one is filled; the two partial partitions with the widest spread are
merged again and again, the fullest window of one with the emptiest of the
other, until one near-equal partition is left.  Of whole pieces near-equal windows
differ by more than can be left free, so FINE of the tokens are cut into small
pieces, which the differencing takes last and evens the others out with, and of each
window a 128th is left for what remains.  If a window exceeds the capacity all the
same, there is one window more and the pieces are spread again.  At the end of a
partition what does not fill a window goes into windows of powers of two, which need
no padding.

No shuffle, and memory is bounded by the batch and the pool.  Window numbers are
unique and the same on every run over the same input splits.

Defined cases: a null or empty text is its end token alone; a null doc_id stays
null; a text of any length is cut over as many windows as it fills; repeated rows are
packed as often as they come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows
from .tokenize import default_tokenizer, encoder

SIZE = 2048
#: Bytes of text whose words a worker takes apart at once.
STRETCH = 500_000
GROUP = 32
#: Share of a group's tokens in pieces of a 64th of a window.
FINE = 0.05
END = 1

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of indices of ``sizes`` whose sums are near-equal (Karmarkar-Karp)."""
    if not sizes:
        return [[] for _ in range(k)]
    # A partial partition: window sums less their smallest, ascending, with their members.
    heap = [(-s, i, [(0, ())] * (k - 1) + [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x + y, (p, q) if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda w: w[0])
        low = merged[0][0]
        merged = [(x - low, p) for x, p in merged]
        heapq.heappush(heap, (-merged[-1][0], tie, merged))
        tie += 1

    def members(p) -> list[int]:
        out, todo = [], [p]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                out.append(x)
        return sorted(out)

    return [members(p) for _, p in heap[0][2]]


class Packer:
    """Takes documents' ids, gives rows of SCHEMA."""

    def __init__(self, first: int, size: int = SIZE, group: int = GROUP):
        self.next, self.size, self.group = first, size, group
        self.fill, self.unit = size - size // 128, max(1, size // 64)
        self.pool: list[tuple] = []  # doc_id, start, ids, document's tokens
        self.held = 0
        self.out: list[tuple] = []

    def window(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.window([(doc, at, ids[at : at + self.size], len(ids))])
        if whole < len(ids):
            self.put((doc, whole, ids[whole:].copy(), len(ids)))
            if self.held >= self.group * self.size:
                self.spread()

    def put(self, piece: tuple) -> None:
        self.pool.append(piece)
        self.held += len(piece[2])

    def cut(self, piece: tuple, most: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[:most], total), (doc, start + most, ids[most:], total)

    def spread(self) -> None:
        """Packs the pool's tokens but for less than a window's."""
        k, over = divmod(self.held, self.fill)
        pieces, back = self.pool, []
        while over:  # the pool's tokens become a whole number of windows, none quite full
            last = pieces.pop()
            if len(last[2]) > over:
                kept, last = self.cut(last, len(last[2]) - over)
                pieces.append(kept)
            over -= len(last[2])
            back.append(last)
        small, fine = [], int(FINE * k * self.size) if k > 1 else 0
        while fine > 0:
            last = pieces.pop()
            while last and fine > 0:
                one, last = self.cut(last, self.unit) if len(last[2]) > self.unit else (last, None)
                small.append(one)
                fine -= len(one[2])
            if last:
                pieces.append(last)
        pieces += small
        sizes = [len(p[2]) for p in pieces]
        windows = difference(sizes, k)
        while max(sum(sizes[i] for i in w) for w in windows) > self.size:
            k += 1
            windows = difference(sizes, k)
        self.pool, self.held = [], 0
        for w in windows:
            if w:
                self.window([pieces[i] for i in w])
        for piece in back:
            self.put(piece)

    def finish(self) -> None:
        while self.held >= self.fill:
            self.spread()
        while self.held:
            room = 1 << (self.held.bit_length() - 1)
            own = []
            while room:
                piece = self.pool.pop(0)
                if len(piece[2]) > room:
                    piece, rest = self.cut(piece, room)
                    self.pool.insert(0, rest)
                own.append(piece)
                room -= len(piece[2])
                self.held -= len(piece[2])
            self.window(own)


def pack(documents: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, most_words: int | None = None) -> DataFrame:
    """Pieces of all documents with the window (``sequence_id``) and place (``offset``) of each.

    ``most_words`` bounds the table of known words that a Python worker keeps.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, size)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

        def drain() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(schema))], schema=schema)

        for docs, texts in rows(batches, 1, STRETCH):
            ids, counts = encoder(path, most_words).encode(texts, end)
            at = 0
            for doc, n in zip(docs, counts.tolist()):
                packer.add(doc, ids[at : at + n])
                at += n
            yield drain()
        packer.finish()
        yield drain()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
