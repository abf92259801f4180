"""Near-duplicate documents of a corpus: SimHash first, an exact set-similarity join for the rest (the pipeline's stage).

A document's tokens are the XXH64 hashes of its five-word shingles (a shorter text:
all its words as one), as a set.  Two documents are linked if the Jaccard similarity
of their sets is 0.8 or more; of each component of links one document stays.

1. Documents with one set are one node.
2. Operator 3's covering masks find the nodes whose fingerprints (majority bits of the
   set) are near each other; each is compared with the smallest of its group.  Most
   large groups of near copies are settled by that.  Three of 64 bits reach only a
   part of the pairs at 0.8, so the join goes on for the others.
3. Prefix filter: under any one order of all tokens, two sets that match share one
   of their first n - ceil(0.8 n) + 1 tokens.  The order is by counts in a table of
   2**COUNT_BITS buckets, over all tokens of all documents, then by the hash; the
   counts decide how much is compared, never what is found.
4. Each node is compared with the smallest of each token.  Then all pairs of a token
   that are not yet in one component.
5. Parity sketches drop pairs that can't reach 0.8; the others' similarities are verified
   on whole sets, built again for them only.

Defined cases: null, empty and white-space texts have one (empty) set and are
copies of each other.  The row of the smallest doc_id stays, null ids come last, then
the smallest hash of the text decides; rows equal in both are one.  Rows that share
a doc_id and differ in their texts are documents of their own.  Texts of any length
are taken whole; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import drop, grow, rows, shrink, stage
from .components import connected
from .simhash import majority, shingle_hashes

WIDTH = 5
#: Buckets of the table of token counts that workers know (8 MB), the pieces it is summed in, and the groups of tasks whose pieces are summed first.
COUNT_BITS, PIECES, GROUPS = 20, 64, 1024
#: Rows up to which tables of ids are broadcast, and tables of tokens.
BROADCAST_ROWS, BROADCAST_TOKENS = 2_000_000, 200_000
#: Bits of the map of shared tokens that workers know: at least so many for each of them, up to 2**MAP_BITS (16 MB); and bits of one piece of it.
BITS_EACH, MAP_BITS, PIECE_BITS = 32, 27, 15
#: Bytes of text that a worker takes at once, and tokens whose bits it unpacks at once.
STRETCH, BITS_OF = 500_000, 20_000


def token_set(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64))


def node_of(tokens: np.ndarray) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >> 63 else h


def prefix(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens one of which every matching set shares, by the counts of their buckets, then by their hashes."""
    n = len(tokens)
    if not n:
        return tokens
    bits = len(counts).bit_length() - 1
    seen = counts[(tokens >> np.uint64(64 - bits)).astype(np.int64)]
    return tokens[np.lexsort((tokens, seen))][: n - (4 * n + 4) // 5 + 1]


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits, about a bit for each token.  Two sets differ by at least as many tokens as their parities by bits."""
    size = 64 << max(0, (max(1, len(tokens)) - 1).bit_length() - 6)
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_match(n: int, m: int, a: bytes, b: bytes) -> bool:
    """False only for sets of n and m tokens whose sketches exclude a similarity of 0.8."""
    if min(n, m) * 5 < max(n, m) * 4:
        return False
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # parities by one bit less each time
    need = -(-4 * (n + m) // 9)
    return int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * need


def _sets(texts: DataFrame, counts: np.ndarray | None) -> DataFrame:
    """key, node, n, tokens, fingerprint and sketch of (key, text).  tokens: the prefix under ``counts``, or the whole set and no more."""
    shared = None if counts is None else texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, some in rows(batches, 1, STRETCH):
            sets = [token_set(t) for t in some]
            sizes = np.array([len(s) for s in sets], np.int64)
            shown, sketches, prints = sets, [None] * len(sets), np.zeros(len(sets), np.int64)
            if shared is not None:
                shown, sketches = [prefix(s, shared.value) for s in sets], [sketch(s) for s in sets]
                prints = majority(np.concatenate([np.zeros(0, np.uint64), *sets]), sizes, BITS_OF).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in shown])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *shown]).view(np.int64)
            columns = [pa.array(keys, pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(prints), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n", "tokens", "fp", "sketch"])

    return texts.select("key", "text").mapInArrow(run, "key long, node long, n int, tokens array<long>, fp long, sketch binary")


def token_counts(texts: DataFrame) -> np.ndarray:
    """How often the tokens of each bucket (by their upper bits) occur in all texts; its size does not depend on the texts."""
    bits = COUNT_BITS
    size = 1 << bits
    piece = size // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        for (some,) in rows(batches, 0, STRETCH):
            found = np.concatenate([np.zeros(0, np.uint64), *map(token_set, some)])
            at, n = np.unique((found >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            total[at] += n
        group = pa.array(np.full(PIECES, TaskContext.get().partitionId() % GROUPS, np.int32))
        pieces = [shrink(total[k * piece : (k + 1) * piece]) for k in range(PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), group, pa.array(pieces, pa.binary())], ["k", "of", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(piece, np.int64)
        for x in table["n"]:
            total += grow(x.as_py()).astype(np.int64)
        return pa.table({"k": table["k"][:1], "of": table["of"][:1], "n": pa.array([shrink(total)], pa.binary())})

    schema = "k int, of int, n binary"
    got = texts.select("text").mapInArrow(count, schema).groupBy("k", "of").applyInArrow(add, schema).groupBy("k").applyInArrow(add, schema).collect()
    out = np.zeros(size, np.int64)
    for row in got:
        out[row["k"] * piece : (row["k"] + 1) * piece] = grow(row["n"])
    return out


def _hint(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _sifted(prints: DataFrame, shared: DataFrame) -> DataFrame:
    """node, n and token of the prefixes, without tokens whose bit no token of ``shared`` sets; all that are in ``shared`` stay.

    So few of the others are exchanged; the map's size has a bound, whatever the number of tokens.
    """
    bits = min(MAP_BITS, max(PIECE_BITS, (shared.count() * BITS_EACH).bit_length()))
    # The lower bits: prefixes and shared tokens crowd where the counts by upper bits are small.
    at = shared.select(F.col("token").bitwiseAND(F.lit((1 << bits) - 1)).alias("at")).select(F.shiftright("at", PIECE_BITS).alias("k"), F.col("at").bitwiseAND(F.lit((1 << PIECE_BITS) - 1)).alias("bit"))
    # Dealt out by piece first, so that no task sends pieces of its own.
    pieces = at.repartition("k").groupBy("k").agg(F.bitmap_construct_agg("bit").alias("m")).collect()
    size = 1 << PIECE_BITS - 3
    total = np.zeros(1 << bits - 3, np.uint8)
    for k, m in pieces:
        total[k * size : (k + 1) * size] = np.frombuffer(m, np.uint8)
    known = prints.sparkSession.sparkContext.broadcast(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            place = np.asarray(flat) & ((1 << bits) - 1)
            keep = (known.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            before = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
            ends = before[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(keep)))], ["node", "n", "tokens"])

    return prints.select("node", "n", "tokens").mapInArrow(run, "node long, n int, tokens array<long>").select("node", "n", F.explode("tokens").alias("token"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The staged pairs (a, b) whose sets have a similarity of 0.8 or more.  nodes: node, n, sketch, key (of a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_match(*r) for r in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = nodes.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("s"))
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t"))
    close = stage(pairs.join(own, "a").join(other, "b").select("a", "b", "n", "m", "s", "t").mapInArrow(run, "a long, b long"), "near-close")
    some = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    wanted = stage(nodes.join(some, "node", "left_semi").select("key"), "near-wanted")
    sets = stage(_sets(texts.join(_hint(wanted), "key", "left_semi"), None).dropDuplicates(["node"]).select("node", "tokens"), "near-sets")
    left = sets.withColumnsRenamed({"node": "a", "tokens": "s"}).join(_hint(close), "a")
    both = left.join(sets.withColumnsRenamed({"node": "b", "tokens": "t"}), "b")
    held = F.size(F.array_intersect("s", "t"))
    out = stage(both.filter(held * 9 >= (F.size("s") + F.size("t")) * 4).select("a", "b").distinct(), "near-links")
    drop(pairs, close, wanted, sets)
    return out


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints operator 3 puts into one group: each node with the group's smallest."""
    nodes = stage(prints.select("node", "fp").distinct(), "near-fingerprints")
    labels = connected(simhash.links(nodes.select("fp").distinct()))
    grouped = stage(nodes.join(labels.withColumnRenamed("node", "__fp"), F.col("fp") == F.col("__fp"), "left").select("node", F.coalesce("label", "fp").alias("label")), "near-groups")
    least = grouped.groupBy("label").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b <> most").select("label", "b")
    out = stage(grouped.join(least, "label").filter("node <> b").select(F.col("node").alias("a"), "b"), "near-first")
    drop(nodes, grouped)
    return out


def links(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes of a component, and no others.  prints: key, node, n, tokens (the prefix), fp, sketch."""
    pairs = _by_fingerprint(prints)
    tokens = prints.select("node", "n", F.explode("tokens").alias("token"))
    shared = stage(tokens.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("token", "least"), "near-shared")
    few = shared.count() <= BROADCAST_TOKENS
    held = tokens.join(F.broadcast(shared), "token") if few else _sifted(prints, shared).join(shared, "token")
    members = stage(held.select("token", "least", "node", "n").distinct(), "near-members")
    some = stage(members.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "near-nodes")
    nodes = stage(prints.select("node", "n", "sketch", "key").join(_hint(some), "node", "left_semi").dropDuplicates(["node"]), "near-sketches")
    found = _verified(pairs, nodes, texts)
    drop(pairs, shared, some)
    # The smallest node of each token, unless it is in one component with the node already.
    labels = connected(found)
    other = labels.withColumnsRenamed({"node": "least", "label": "l_label"})
    first = members.filter("node <> least").select("node", "least").distinct().join(labels, "node", "left").join(other, "least", "left")
    first = first.filter(F.coalesce("label", "node") != F.coalesce("l_label", "least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = found.unionByName(_verified(stage(first, "near-pairs"), nodes, texts))
    labels = connected(found)
    labelled = stage(members.join(labels, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label")), "near-labelled")
    drop(members)
    # Of a token with two nodes the pair is compared already.
    apart = stage(labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c")).filter("x <> y and c > 2").select("token"), "near-apart")
    open_ = labelled.join(_hint(apart, BROADCAST_TOKENS), "token")
    other = open_.withColumnsRenamed({"node": "l_node", "n": "l_n", "label": "l_label"})
    rest = open_.join(other, "token").filter("node > l_node and label <> l_label and least(n, l_n) * 5 >= greatest(n, l_n) * 4")
    found = found.unionByName(_verified(stage(rest.select(F.col("node").alias("a"), F.col("l_node").alias("b")).distinct(), "near-pairs"), nodes, texts))
    drop(labelled, apart, nodes)
    return found


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each component.  Columns stay as they are."""
    key = F.xxhash64("text")
    texts = documents.select(key.alias("key"), "text")
    prints = stage(_sets(texts, token_counts(texts)), "near-prints")
    labels = connected(links(texts, prints))
    of = prints.select("key", "node").distinct().join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    of = stage(of, "near-of")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col("key"))
    least = documents.select("doc_id", key.alias("key")).join(of, "key").groupBy("label").agg(F.min(place).alias("f"))
    keep = stage(least.select(F.col("f.id").alias("__vw_id"), F.col("f.key").alias("__vw_first")), "near-kept")
    drop(prints)
    kept = documents.withColumn("__vw_key", key)
    chosen = (F.col("__vw_key") == F.col("__vw_first")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__vw_id"))
    kept = kept.join(_hint(keep), chosen, "left_semi")
    # Rows equal in id and text are few; only they are shuffled with their texts.
    twice = stage(documents.groupBy(F.col("doc_id").cast("long").alias("__vw_id"), key.alias("__vw_first")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "near-twice")
    if twice.isEmpty():
        return kept.drop("__vw_key")
    once = kept.join(_hint(twice), chosen, "left_anti")
    return once.unionByName(kept.join(_hint(twice), chosen, "left_semi").dropDuplicates(["doc_id", "__vw_key"])).drop("__vw_key")
