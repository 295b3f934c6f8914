"""Connected components of a graph given by edges, by alternating large and small stars.

Each round hangs every node's larger neighbours on its smallest neighbour, then every node's smaller ones; the number of rounds
grows with the logarithm of the number of nodes. Edges stay in tables: every round is written to the shared folder, and only a
count and a checksum of them reach the driver. A round's tables are deleted when the next one's are written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.shared import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is the smallest node that can be reached."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("x"), F.col("m"), "u")
        # the smallest neighbour takes the node itself and its other smaller neighbours
        last, edges = edges, written(small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        forget(last, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


class Forest:
    """Union-find over 0..n-1 within a task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
        """Joins pairs; returns those that joined two trees."""
        used = []
        for a, b in zip(one.tolist(), two.tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                used.append((a, b))
        return used
