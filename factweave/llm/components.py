"""Connected components of a link table by alternating star contraction.

Every round is two grouped minima and two joins on the link table, written to shared
storage; the number of rounds grows with the logarithm of the longest chain. Nothing is
collected but one checksum per round. The side that holds one row per node is the small
side of each join, so a hub with very many links is split by the adaptive skew join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from factweave.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or to the node itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger node `a` to `b`; a node's smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: columns a, b. Returns node and root, the smallest node of its component, for every linked node but the roots.

    Self-links and repeated links are allowed; nulls are not.
    """
    now = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
        if mark.n == 0 or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = stage(_small_star(_large_star(now)), name)


class Forest:
    """Union of links among the rows 0..n-1 of one task; a row's root is its smallest linked row."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
