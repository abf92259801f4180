"""Connected components, in numpy for a bounded group and as DataFrames for any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def roots(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest node of its component, by the links a-b (on top of ``start``)."""
    root = np.arange(n) if start is None else start.copy()
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b), both long; label: the component's smallest node.

    Alternating large-star and small-star rounds: each is a minimum by node, which
    combines before the shuffle, and an equi-join of two staged tables, which
    adaptive execution can split where a node has very many links.  The number
    of rounds is logarithmic in practice; nothing is gathered on the driver but
    a count and a checksum.
    """
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # Large star: every larger neighbour goes to the smallest of the neighbourhood.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = stage(large, "links")
        # Small star: so do the node itself and its smaller neighbours.
        least = stage(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stage(small.filter("a <> b").distinct(), "links")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stage(labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct(), "labels")
