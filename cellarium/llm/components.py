"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import cut


class Forest:
    """Roots of nodes under links, joined in whole arrays."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.root[x], self.root[y]
            differ = a != b
            x, y, a, b = x[differ], y[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of links(a, b). Each round shuffles the links only.

    A large star hangs a node's larger neighbours on its smallest one, a small star its smaller ones; both are joins of
    the links with a grouped minimum, so a node with very many links is summed before the shuffle and split by AQE.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    while True:
        before = _mark(edges)
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("r"))
        large = edges.join(least, F.col("lo") == F.col("n")).select("hi", F.col("r").alias("lo"))
        # The smaller end moves to its own smallest neighbour; the larger end keeps a link to the same root.
        large = large.filter("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("r"))
        small = large.join(least, "hi")
        small = small.select(F.explode(F.array(F.struct("hi", F.col("r").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("r").alias("lo")))).alias("e"))
        edges = cut(small.select("e.hi", "e.lo").filter("hi <> lo").distinct())
        if _mark(edges) == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sums, equal for equal link sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.col("lo").cast("decimal(38,0)"))).first()
    return tuple(row)
