"""Connected components of link tables, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def link(self, linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Join the ends of all pairs that a block marks; work in Python is per member, not per pair."""
        r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(r):
            return
        block = linked[np.ix_(r, c)]
        left, right = rows[r].copy(), cols[c].copy()
        none = np.iinfo(np.int64).max
        while True:
            to_left = np.minimum(left, np.where(block, right[None, :], none).min(1))
            to_right = np.minimum(right, np.where(block, to_left[:, None], none).min(0))
            if (to_left == left).all() and (to_right == right).all():
                break
            left, right = to_left, to_right
        for i, j in zip([*rows[r].tolist(), *cols[c].tolist()], [*left.tolist(), *right.tolist()], strict=True):
            if i != j:
                self.union(i, j)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, root): the smallest node that links reach.

    Null ends are left out, self links and repeated links change nothing, an empty table gives an
    empty result. Each round is an aggregate and an equi-join on the node, written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    edges = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
