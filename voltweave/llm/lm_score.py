"""Language-model scores by deleted interpolation (operator 7).

    P(w | v) = l2[b] c(v w)/c(v) + l1[b] c(w)/N + l0[b] / (V + 1)

with the maximum-likelihood bigram and unigram of all training documents, a
uniform share for what was never seen, and mixture weights by bucket b of the
context's frequency (its binary logarithm).  Expectation-maximisation learns the
weights on held-out counts: the tokens of one fold of the training documents,
each with its own occurrence deleted from the counts.  Tokens alike in their three
counts are one row of a table; a round of EM is one aggregate over it, by bucket.

Counts cover the corpus.  A word is a 62-bit hash, a bigram a 56-bit one.  Texts
become chunks of about a million tokens, stored once.  A chunk asks for the
counts of its different words and bigrams: its sorted keys go, as compressed
differences, to the parts of the key range that hold them (about 4 bytes a key
instead of the 30 of a row), every part sums the training counts of all chunks,
and the sums go back in the order of the chunk's keys.  Frequent words cost one
key a chunk, so no part is hot.  Parts and chunks are bounded by parameters;
their number grows with the input.

Defined cases: null text is empty, which is the end token alone; a null doc_id
counts as the empty string for the folds; repeated rows count as often as they
come; a text of any length is scored whole; without training tokens N and V are 0, and
without any of the tuning fold the weights stay equal.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, grow, rows, settle, shrink, stage

FOLDS, HELD_OUT, TUNING = 7, 2, 3
CHUNK_BYTES = 6_000_000
#: Text that is hashed at once, and the powers that are kept for it: 16 bytes each, for as long as a Python worker lives.
HASH_BYTES = 250_000
#: Tokens of the corpus for each part of the key range.
PART_TOKENS = 1_500_000
WORD_BITS, PAIR_BITS = 62, 56
#: Rounds of EM at most; it ends when no weight moves by more than SETTLED.
ROUNDS, SETTLED = 30, 1e-4
#: Buckets of the context's frequency: 0 and the binary logarithms of 64-bit counts.
BUCKETS = 65

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Keys of the end of a text, and of what stands before its first word.
END, START = np.uint64(1), np.uint64(2)

_powers: list[np.ndarray] = []


def _table() -> np.ndarray:
    return np.random.default_rng(20_240_601).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)


_BYTES = _table()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least; those for a text beyond HASH_BYTES are not kept."""
    made = lambda size: [np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE)]
    if n > 2 * HASH_BYTES:
        return made(n)
    if not _powers:
        _powers[:] = made(2 * HASH_BYTES)
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def token_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(key of each token, tokens of each text); every text ends with END.

    Taken in stretches of about HASH_BYTES, a longer text alone: each byte costs some 40 bytes on the way.
    """
    out, some, size = [], [], 0
    for t in texts:
        part = (t or "").encode("utf-8", "surrogatepass").lower()
        if some and size + len(part) + 1 > HASH_BYTES:
            out.append(_stretch_keys(some))
            some, size = [], 0
        some.append(part)
        size += len(part) + 1
    out.append(_stretch_keys(some))
    return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])


def _stretch_keys(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    up, down = _powers_to(len(data) + 1)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    begin = np.flatnonzero(~space & before)
    stop = np.flatnonzero(space & ~before)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    words = _mix((run[stop] - run[begin]) * down[begin] + (stop - begin).astype(np.uint64)) >> np.uint64(64 - WORD_BITS)
    words[words < 4] += np.uint64(4)
    edge = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    last = np.searchsorted(begin, edge)  # words up to each text's end
    keys = np.full(len(words) + len(parts), END, np.uint64)
    mask = np.ones(len(keys), bool)
    mask[last + np.arange(len(parts))] = False
    keys[mask] = words
    return keys, np.diff(np.concatenate([[0], last])) + 1


def pair_keys(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    context = np.concatenate([[START], tokens[:-1]])
    context[np.cumsum(counts) - counts] = START
    return _mix(context * np.uint64(0xC2B2AE3D27D4EB4F) + tokens) >> np.uint64(64 - PAIR_BITS)


def shrink_sorted(keys: np.ndarray) -> bytes:
    return shrink(np.diff(keys, prepend=np.uint64(0)))


def grow_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(grow(data), dtype=np.uint64)


CHUNKS = "chunk long, tuning boolean, docs binary, no_id binary, held binary, counts binary, words binary, at binary, tokens long, train_docs long"


def chunks(documents: DataFrame) -> DataFrame:
    """Tokenised documents, about CHUNK_BYTES of text in a row, the tuning fold apart."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for ids, texts, folds in rows(batches, 1, CHUNK_BYTES):
            folds = np.array(folds)
            for tuning in (False, True):
                own = np.flatnonzero((folds == TUNING) == tuning)
                if not len(own):
                    continue
                keys, counts = token_keys([texts[i] for i in own])
                words, at = np.unique(keys, return_inverse=True)
                held = folds[own] == HELD_OUT
                row = (
                    chunk,
                    tuning,
                    np.array([ids[i] or 0 for i in own], np.int64).tobytes(),
                    np.array([ids[i] is None for i in own]).tobytes(),
                    held.tobytes(),
                    shrink(counts),
                    shrink_sorted(words),
                    shrink(at),
                    len(keys),
                    int((~held).sum()),
                )
                chunk += 1
                kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in CHUNKS.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), "text", fold.alias("fold")).mapInArrow(run, CHUNKS)


class Chunk:
    """A row of chunks() with its different words and pairs."""

    def __init__(self, row: dict):
        self.docs, self.no_id = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["no_id"], bool)
        self.held, self.counts = np.frombuffer(row["held"], bool), grow(row["counts"]).astype(np.int64)
        self.words, self.at = grow_sorted(row["words"]), grow(row["at"]).astype(np.int64)
        self.pairs, self.pair_at = np.unique(pair_keys(self.words[self.at], self.counts), return_inverse=True)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of chunks one at a time: a batch holds all of a task's, several megabytes each."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _bounds(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    edges = np.array([(p << bits) // parts for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


REQUEST = "part int, chunk long, words binary, word_n binary, pairs binary, pair_n binary"
REPLY = "chunk long, part int, words binary, pairs binary, n long, v long"


def replies(stored: DataFrame, parts: int) -> DataFrame:
    """For each chunk and part the training counts of the chunk's keys; and rows with chunk -1: n tokens, v words of a part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            c = Chunk(row)
            train = np.repeat(~c.held, c.counts)
            word_n = np.bincount(c.at[train], minlength=len(c.words))
            pair_n = np.bincount(c.pair_at[train], minlength=len(c.pairs))
            w, p = _bounds(c.words, WORD_BITS, parts), _bounds(c.pairs, PAIR_BITS, parts)
            out = [(k, row["chunk"], shrink_sorted(c.words[w[k] : w[k + 1]]), shrink(word_n[w[k] : w[k + 1]]), shrink_sorted(c.pairs[p[k] : p[k + 1]]), shrink(pair_n[p[k] : p[k + 1]])) for k in range(parts)]
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], [c.split()[0] for c in REQUEST.split(", ")])

    def total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        different, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts).astype(np.float64), len(different)).astype(np.uint64)
        return np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1]), sums

    def add(table: pa.Table) -> pa.Table:
        cols = table.to_pydict()
        words, sums = total([grow_sorted(x) for x in cols["words"]], [grow(x) for x in cols["word_n"]])
        pairs, _ = total([grow_sorted(x) for x in cols["pairs"]], [grow(x) for x in cols["pair_n"]])
        n, part = len(words), cols["part"][0]
        return pa.table(
            {
                "chunk": pa.array([*cols["chunk"], -1], pa.int64()),
                "part": pa.array([part] * (n + 1), pa.int32()),
                "words": pa.array([*map(shrink, words), b""], pa.binary()),
                "pairs": pa.array([*map(shrink, pairs), b""], pa.binary()),
                "n": pa.array([0] * n + [int(sums.sum())], pa.int64()),
                "v": pa.array([0] * n + [int((sums > 0).sum())], pa.int64()),
            }
        )

    asked = stored.select("chunk", "docs", "no_id", "held", "counts", "words", "at").mapInArrow(ask, REQUEST)
    return asked.groupBy("part").applyInArrow(add, REPLY)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + its binary logarithm."""
    return np.frexp(context.astype(np.float64))[1]


class Counted:
    """A chunk's tokens with their training counts: c2 of the pair, cc of the context, c1 of the word."""

    def __init__(self, row: dict, train_docs: int):
        self.chunk = c = Chunk(row)
        got = sorted(row["got"], key=lambda g: g["part"])
        self.c1 = np.concatenate([grow(g["words"]) for g in got]).astype(np.int64)[c.at]
        self.c2 = np.concatenate([grow(g["pairs"]) for g in got]).astype(np.int64)[c.pair_at]
        self.cc = np.concatenate([[train_docs], self.c1[:-1]])
        self.cc[np.cumsum(c.counts) - c.counts] = train_docs


def learn(counts: DataFrame, n: int, unseen: float) -> np.ndarray:
    """Weights (bucket, [l2, l1, l0]) by EM from rows (b, cc, c2, c1, times) of held-out counts.

    Only three sums a bucket come to the driver in each round.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    like = [F.try_divide(F.col("c2"), F.col("cc").cast("double")), F.col("c1") / F.lit(float(max(n - 1, 1))), F.lit(unseen)]
    table = counts.select("b", "times", *[F.coalesce(x, F.lit(0.0)).alias(f"p{k}") for k, x in enumerate(like)])
    for _ in range(ROUNDS):
        own = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("b") + 1) * F.col(f"p{k}") for k in range(3)]
        shares = table.select("b", "times", *[x.alias(f"s{k}") for k, x in enumerate(own)]).withColumn("share", F.col("times") / (F.col("s0") + F.col("s1") + F.col("s2")))
        sums = np.full((BUCKETS, 3), 1e-3)
        for row in shares.groupBy("b").agg(*[F.sum(F.col(f"s{k}") * F.col("share")) for k in range(3)]).collect():
            sums[row[0]] += row[1:]
        before, weights = weights, sums / sums.sum(axis=1, keepdims=True)
        if np.abs(weights - before).max() <= SETTLED:
            break
    weights[0] = (0.0, *(weights[0, 1:] / weights[0, 1:].sum()))  # no context, no bigram
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    stored = stage(chunks(documents), "lm-chunks")
    size = stored.agg(F.sum("tokens"), F.sum("train_docs")).first()
    tokens, train_docs = size[0] or 0, size[1] or 0
    counted = stage(replies(stored, max(1, -(-tokens // PART_TOKENS))), "lm-counts")
    totals = counted.filter("chunk < 0").agg(F.sum("n"), F.sum("v")).first()
    n, v = totals[0] or 0, totals[1] or 0
    got = counted.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "words", "pairs")).alias("got"))
    unseen = 1 / (v + 1)

    def held_out_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            c = Counted(row, train_docs)
            found = np.stack([c.cc - 1, c.c2 - 1, c.c1 - 1], axis=1)  # this occurrence is deleted
            found, times = np.unique(found, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (bucket(found[:, 0]), *found.T, times)], ["b", "cc", "c2", "c1", "times"])

    tuning = stored.filter("tuning").join(got, "chunk").mapInArrow(held_out_counts, "b long, cc long, c2 long, c1 long, times long")
    settle(spark)
    alike = stage(tuning.groupBy(F.col("b").cast("int").alias("b"), "cc", "c2", "c1").agg(F.sum("times").alias("times")), "lm-tuning")
    weights = learn(alike, n, unseen)
    drop(alike)
    settle(spark)  # the rounds have filled the heaps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            c = Counted(row, train_docs)
            w = weights[bucket(c.cc)]
            p = w[:, 0] * c.c2 / np.maximum(c.cc, 1) + w[:, 1] * c.c1 / max(n, 1) + w[:, 2] * unseen
            first = np.cumsum(c.chunk.counts) - c.chunk.counts
            add = lambda x: np.add.reduceat(x, first)
            base = np.log10((c.c1 + 1) / (n + v + 1))
            cols = [
                pa.array(c.chunk.docs, pa.int64(), mask=c.chunk.no_id),
                pa.array(c.chunk.held),
                pa.array(c.chunk.counts),
                pa.array(add((c.c1 > 0).astype(np.int64))),
                pa.array(np.full(len(first), n, np.int64)),
                pa.array(add(base)),
                pa.array(add(np.log10(p))),
            ]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORES.split(", ")])

    return stored.join(got, "chunk").mapInArrow(run, SCORES)
