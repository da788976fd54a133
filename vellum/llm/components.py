"""Connected components: of the links a task has found, and of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import written


def spanning_forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Links that join what the links before them have not joined; they span the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    a, b = [], []
    for left, right in pairs:
        for x, y in zip(left.tolist(), right.tolist()):
            u, v = find(x), find(y)
            if u != v:
                root[u] = v
                a.append(x)
                b.append(y)
    return a, b


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node it sees."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with an edge that is not its component's smallest node.

    ``edges`` has the bigint columns ``a`` and ``b``, ``a <> b``; repeated and
    reversed edges are fine, an empty table gives an empty one. Each round is
    written to the shared folder. Only a count and a checksum reach the driver.
    """
    edges = written(edges.select("a", "b").distinct(), "edges")
    seen = _signature(edges)
    while seen[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
