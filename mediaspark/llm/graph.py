"""Connected components by label contraction; each round is a few joins on saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) for all nodes of the edges (a, b).

    Every round each node takes the smallest of itself and its neighbours, follows that node's own choice, and edges
    shrink to those between different choices. Sums by node are combined before the shuffle and the joins are on
    freshly dealt tables, whose heavy partitions Spark can split, so a hub with very many neighbours is no obstacle.
    """
    edges = util.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = util.save(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to")), "least")
        up = least.select(F.col("node").alias("to"), F.col("to").alias("up"))
        choice = util.save(least.join(up, "to").select("node", F.col("up").alias("to")), "choice")
        if labels is None:
            labels = choice.select("node", F.col("to").alias("component"))
        else:
            step = choice.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = util.save(labels, "labels")
        a = choice.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = choice.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").select("b", "x").join(b, "b").filter("x <> y")
        edges = util.save(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
