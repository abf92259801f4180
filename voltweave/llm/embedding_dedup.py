"""Embedding near-duplicates by quantised tile products (operator 6).

Equal vectors are one class.  Each class's unit vector is rounded once to int8 codes
with its own scale s and its own rounding error e = |u - s q|, computed, not
estimated.  Classes are dealt into blocks of about BLOCK; every pair of blocks (a
tile) is one row of work, and only codes, scales and errors travel to it.  For unit
vectors u, v

    |u.v - s_u s_v (q_u . q_v)| <= e_u + (1 + e_u) e_v

so most pairs are links for certain or none for certain.  The others, whose bounds
hold the threshold between them, are computed again from the vectors as given, in
double precision; only the vectors of such pairs are fetched, for each tile that has
any.  Products of codes are exact: they are integers below 2**24 in a float matrix
product (wider vectors are added up in parts).  A tile returns, for each of its linked
classes, how many vectors it links and a class of its component in the tile; pairs
stay within their tile's row.

The work is quadratic in the number of different vectors, as the method is; the
tiles are independent rows, dealt evenly, so it spreads over all executors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; vectors of different lengths don't
link; vectors of any magnitude are scaled by a power of two first, so no norm is lost;
a null vec_id takes part and counts in n_links, but is no component's id
unless all are null; repeated rows count as vectors of their own.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage
from .components import connected, roots

THRESHOLD = 0.9
BLOCK = 2048
#: Products of int8 codes over this many components stay below 2**24.
EXACT = 1024
#: Components of vectors that are recomputed at once.
CHUNK = 4_000_000


#: What single precision may add to a product of codes, and more.
GRANTED = 1e-5


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows (none zero) times a power of two that brings their largest component to 0.5 up to 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, rounding error) of each row's unit vector."""
    vectors = scaled(vectors)
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    rest = unit - codes * scale[:, None]
    error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) * (1 + 1e-12) + 1e-12
    return codes.astype(np.int8), scale, error


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float32), b.astype(np.float32)
    if a.shape[1] <= EXACT:
        return a @ b.T
    return sum((a[:, k : k + EXACT] @ b[:, k : k + EXACT].T).astype(np.float64) for k in range(0, a.shape[1], EXACT))


def bounded(a: tuple, b: tuple, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of two quantised blocks that may reach the threshold, and which of them do for certain (i < j if the blocks are the same)."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    products = code_products(qa, qb)
    margin = GRANTED + ea[:, None] + (1 + ea[:, None]) * eb[None, :]
    unit = sa[:, None] * sb[None, :]
    i, j = np.nonzero(products >= (threshold - margin) / unit)
    if same:
        i, j = i[i < j], j[i < j]
    return i, j, products[i, j] >= (threshold + margin[i, j]) / unit[i, j]


def exact(vectors: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of rows of ``vectors`` have a cosine of at least the threshold."""
    out = np.zeros(len(i), bool)
    step = max(1, CHUNK // vectors.shape[1])
    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
    for at in range(0, len(i), step):
        x, y = (scaled(vectors[k[at : at + step]].astype(np.float64)) for k in (i, j))
        out[at : at + step] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) >= threshold
    return out


def digest(ids: np.ndarray, ns: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, vectors that it links to, a class of its component) of the linked ones."""
    n = np.bincount(i, ns[j], len(ids)) + np.bincount(j, ns[i], len(ids))
    root, at = roots(len(ids), i, j), np.flatnonzero(n)
    return ids[at], n[at].astype(np.int64), ids[root[at]]


LINKS = "node long, n long, root long"
TILE = "tile long, node binary, n binary, root binary, ids binary, ns binary, i binary, j binary"


def links(classes: DataFrame, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """For each tile and linked class: node, n (vectors of other classes linked), root. ``classes``: cid, embedding, n."""
    blocks = max(1, -(-classes.count() // block))
    number = np.float32 if dict(classes.dtypes)["embedding"] == "array<float>" else np.float64
    names = [c.split()[0] for c in TILE.split(", ")]

    def bundle(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        flat = np.asarray(table["embedding"].combine_chunks().values, dtype=number).reshape(-1, dim)
        codes, scale, error = quantise(flat.astype(np.float64))
        of = lambda name: np.asarray(table[name], dtype=np.int64).tobytes()
        binary = {"ids": of("cid"), "ns": of("n"), "codes": codes.tobytes(), "scale": scale.tobytes(), "error": error.tobytes()}
        return pa.table({"block": table["block"][:1], "dim": table["dim"][:1], **{k: pa.array([v], pa.binary()) for k, v in binary.items()}})

    dealt = classes.select("cid", "n", "embedding", F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block"), F.size("embedding").alias("dim"))
    bundles = stage(dealt.groupBy("block", "dim").applyInArrow(bundle, "block long, dim int, ids binary, ns binary, codes binary, scale binary, error binary"), "embedding-blocks")
    # Each block meets the next half of the blocks round a ring: every pair of blocks once, as many for each.
    half = blocks // 2
    held = ("ids", "ns", "codes", "scale", "error")
    left = bundles.select("dim", F.col("block").alias("block_a"), F.struct(*held).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(half))).alias("step"))
    if blocks % 2 == 0 and blocks > 1:
        left = left.filter((F.col("step") < half) | (F.col("block_a") < half))
    left = left.withColumn("block_b", F.pmod(F.col("block_a") + F.col("step"), F.lit(blocks)))
    right = bundles.select("dim", F.col("block").alias("block_b"), F.struct(*held).alias("b"))
    tile = F.xxhash64("dim", "block_a", "block_b").alias("tile")
    tiles = left.join(right, ["block_b", "dim"]).select(tile, "step", "dim", "a", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number_, step, dim, a, b = (c[k].as_py() for c in batch.columns)
                of = lambda x: (np.frombuffer(x["codes"], np.int8).reshape(-1, dim), np.frombuffer(x["scale"]), np.frombuffer(x["error"]))  # noqa: B023, E731
                i, j, sure = bounded(of(a), of(b), step == 0, threshold)
                if not len(i):
                    continue
                ids, ns = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["ns"], np.int64)
                if step:
                    j = j + len(ids)
                    ids, ns = (np.concatenate([x, np.frombuffer(b[c], np.int64)]) for x, c in ((ids, "ids"), (ns, "ns")))
                found = digest(ids, ns, i[sure], j[sure])
                i, j = i[~sure], j[~sure]
                needed, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                rest = (ids[needed], ns[needed], at[: len(i)].astype(np.int32), at[len(i) :].astype(np.int32))
                row = [number_, *(x.tobytes() for x in (*found, *rest))]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if not n else pa.binary()) for n, v in enumerate(row)], names)

    def sure_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], ["node", "n", "root"])

    def needed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number_, ids in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number_)), pa.array(at)], ["tile", "cid"])

    def again(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, ns = (np.frombuffer(pairs[c][0].as_py(), np.int64) for c in ("ids", "ns"))
        i, j = (np.frombuffer(pairs[c][0].as_py(), np.int32) for c in ("i", "j"))
        known = np.asarray(vectors["cid"], dtype=np.int64)
        order = np.argsort(known)
        flat = np.asarray(vectors["embedding"].combine_chunks().values, dtype=number).reshape(len(known), -1)
        hit = exact(flat[order[np.searchsorted(known, ids, sorter=order)]], i, j, threshold)
        return pa.table([pa.array(x) for x in digest(ids, ns, i[hit], j[hit])], ["node", "n", "root"])

    done = stage(tiles.mapInArrow(multiply, TILE), "embedding-tiles")
    open_ = done.filter(F.length("i") > 0)
    vectors = open_.select("tile", "ids").mapInArrow(needed_ids, "tile long, cid long").join(classes.select("cid", "embedding"), "cid")
    checked = open_.select("tile", "ids", "ns", "i", "j").groupBy("tile").cogroup(vectors.groupBy("tile")).applyInArrow(again, LINKS)
    found = stage(done.select("node", "n", "root").mapInArrow(sure_links, LINKS).unionByName(checked), "embedding-links")
    drop(bundles, done)
    return found


def near_duplicates(embeddings: DataFrame, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, embedding)."""
    embeddings = embeddings.select(F.col("vec_id").cast("long"), "embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(ok, F.lit(False))
    classes = embeddings.filter(usable).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), "embedding", "first", "n"), "embedding-classes")
    found = links(classes, block, threshold)
    labels = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("linked"))
    info = classes.select("cid", "first", "n").join(labels, F.col("cid") == labels.node, "left").drop("node")
    info = info.join(counts, F.col("cid") == counts.node, "left").drop("node")
    info = stage(info.select("cid", "first", F.coalesce("label", "cid").alias("label"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "embedding-info")
    least = stage(info.groupBy("label").agg(F.min("first").alias("component_id")), "embedding-components")
    of = stage(classes.select("cid", "embedding").join(info.join(least, "label").select("cid", "n_links", "component_id"), "cid").drop("cid"), "embedding-of")
    linked = embeddings.filter(usable).join(of, "embedding").select("vec_id", "n_links", "component_id")
    alone = embeddings.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM e
  UNION
  SELECT r.node, n.b FROM reach r JOIN near n ON n.a = r.other)
SELECT vec_id, (SELECT count(*) FROM near WHERE near.a = e.vec_id)::BIGINT AS n_links,
       (SELECT min(other) FROM reach WHERE reach.node = e.vec_id) AS component_id,
       vec_id = (SELECT min(other) FROM reach WHERE reach.node = e.vec_id) AS kept
FROM e
"""
