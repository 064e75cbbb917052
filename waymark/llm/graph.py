"""Connected components of a graph that no single machine has to hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import freed, materialise, salted_join


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); the component is its smallest node.

    Alternating large-star and small-star contraction: each round links the neighbours of a node to the smallest
    of them, until every node hangs on its component's smallest one. Rounds grow with the logarithm of the
    component's size. A hub's neighbours are never gathered: the smallest is a partial aggregate, and is joined
    back on the node, in parts where that has many. Loops and repeated edges do no harm; no edges give an empty table.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    size, seen = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n"))
        large = salted_join(both, low, "u", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.where("low < u").select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        large = materialise(large, "star")
        low = large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        small = salted_join(large, low, "u", 2 * size).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        before, now = now, materialise(small, "star")
        freed(before, large)
        # a fixed point: as many edges, with the same checksum, as a round ago
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen:
            break
        size, seen = mark[0], mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Links among numbered items, kept as a spanning forest."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((i, j))
