"""SimHash near-duplicates by covering locality-sensitive hashing (operator 3).

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of
its 3-word shingles.  Documents with one fingerprint are one node.  Fingerprints
within RADIUS bits are found through structured masks: bit i is given a nonzero
vector of RADIUS + 1 bits, and mask v (for every nonzero v) keeps the bits whose
vector has odd parity with v.  Any RADIUS or fewer differing bits have vectors
that span less than the whole space, so some v is orthogonal to all of them and
its mask keeps none of them: the pair collides in that table.  Nothing is missed.

Members of a bucket agree on the kept bits (about half).  A bucket of more than
BUCKET fingerprints is split by the same construction over the bits left, which
bounds a group at 2**16 fingerprints whatever the input, and still misses nothing.
Groups give the links of their own components only, never all pairs.

Defined cases: null, empty and white-space texts have fingerprint zero and link
like any other; a null doc_id takes part, and a component of null ids only has a
null id; repeated rows stay; texts of any length are read whole.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, stage
from .components import connected, roots

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 4096
#: Hot buckets up to which their keys are broadcast (16 bytes each).
BROADCAST_BUCKETS = 100_000


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, SEED)]
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [h(joined[a:b], SEED) for a, b in zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray, step: int = 200_000) -> np.ndarray:
    """The fingerprint of each text from the hashes of all, ``counts`` of them for each; none: zero."""
    sums = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), step):
        part, own = hashes[at : at + step], owner[at : at + step]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches, 1):
            found = [shingle_hashes(t) for t in texts]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((h for f in found for h in f), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(majority(flat, counts).view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit numbers, one for each nonzero v of radius + 1 bits."""
    n = (1 << (radius + 1)) - 1
    vector = {bit: i % n + 1 for i, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, n + 1)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


TABLES = masks(list(range(64)))
#: For each table the masks over the bits that it leaves.
DEEPER = [masks([b for b in range(64) if not mask >> b & 1]) for mask in TABLES]


def local_links(fps: np.ndarray, radius: int = RADIUS, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links from each linked fingerprint of a group to the smallest (unsigned) of its component in the group."""
    fps = np.unique(fps)
    root = np.arange(len(fps))
    for at in range(0, len(fps), block):
        rows_ = fps[at : at + block]
        for to in range(at, len(fps), 4 * block):
            i, j = np.nonzero(np.bitwise_count(rows_[:, None] ^ fps[None, to : to + 4 * block]) <= radius)
            i, j = i + at, j + to
            i, j = i[i < j], j[i < j]
            if len(i):
                root = roots(len(fps), i, j, root)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints (fp, distinct) within the radius, and no others."""
    kept = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("k")) for i, m in enumerate(TABLES)]))
    table = distinct.select("fp", kept.alias("x")).select("x.t", "x.k", "fp")
    counts = table.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(counts, "simhash-buckets")
    hot = shared.filter(F.col("n") > bucket)
    n_shared, n_hot = shared.count(), hot.count()

    def small(x: DataFrame, n: int) -> DataFrame:
        return F.broadcast(x) if n <= BROADCAST_BUCKETS else x

    if n_hot:
        plain = table.join(small(shared.filter(F.col("n") <= bucket).select("t", "k"), n_shared), ["t", "k"])
        deep = table.join(small(hot.select("t", "k"), n_hot), ["t", "k"])
        under = [F.array(*[F.struct(F.lit(i).alias("u"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("l")) for i, m in enumerate(ms)]) for ms in DEEPER]
        deep = deep.select("t", "k", "fp", F.explode(F.element_at(F.array(*under), F.col("t") + 1)).alias("x"))
        groups = plain.groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps").unionByName(deep.groupBy("t", "k", "x.u", "x.l").agg(F.collect_list("fp").alias("fps")).select("fps"))
    else:
        groups = table.join(small(shared.select("t", "k"), n_shared), ["t", "k"]).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, edge = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            a, b = [], []
            for s, e in zip(edge[:-1], edge[1:]):
                x, y = local_links(flat[s:e].view(np.uint64))
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)], ["a", "b"])

    return groups.filter(F.size("fps") > 1).mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row."""
    prints = stage(fingerprints(documents), "simhash-prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = connected(links(distinct.select("fp"), bucket))
    labelled = stage(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    least = stage(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-components")
    of = stage(labelled.join(least, "label").select("fp", "component_id"), "simhash-of")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

