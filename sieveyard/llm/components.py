"""Connected components by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveyard.llm.staging import drop, stage


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node number of each node's component, for nodes 0 .. n-1 and edges a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _round(e: DataFrame) -> DataFrame:
    """A large and a small star over edges a > b."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Each node has one smaller neighbour, and that has none."""
    nodes = e.select("a", F.lit(1).alias("n"), F.lit(0).alias("below")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("n"), F.lit(1).alias("below")))
    open_ = nodes.groupBy("a").agg(F.sum("n").alias("n"), F.max("below").alias("below")).where("n > 1 or n = 1 and below = 1")
    return not open_.limit(1).count()


def _edges(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)``, any direction, repeats allowed -> ``(node, component)`` for each node that is not its
    component's smallest; a node that is missing from the result is its own component.

    Each round joins edges to each node's smallest neighbour, hot nodes included (those joins can be split), and
    stages the result in place of the one before; the number of rounds grows with the logarithm of the number of nodes.
    """
    e = stage(_edges(edges), "edges")
    for _ in range(rounds):
        if _settled(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last, e = e, stage(_round(e), "stars")
        drop(last)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
