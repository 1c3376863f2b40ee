"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import stored


def _open(edges: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or one and a larger one: if none has, every component is a star around its smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1").agg(F.count("*")).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``, each a non-null bigint: node, root (the smallest node reachable), for every node that has an edge.

    Each round rewires every node's larger neighbours, then its smaller ones, to the smallest, until each component is a star around
    its smallest node. Rounds grow with the logarithm of the nodes, and no round adds edges. Links found twice on the way to
    ``large`` are as many as the edges at most and fall together in ``small``.
    """
    edges, first = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), True
    while first or _open(edges):
        first = False
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large-stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "small-stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, fewer than there are nodes: each node with its component's smallest."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(step := new[new], new):
            new = step
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
