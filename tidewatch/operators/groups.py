"""Connected components of small-degree graphs by hooking to the least neighbour and doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.operators.grid import cut


def components(pairs: DataFrame) -> DataFrame:
    """(k, component) of the graph of pairs (a, b): the least node that can be reached.

    Each round sends the least label to the neighbours and then jumps to the label's own label, so the rounds follow
    the logarithm of the longest path. Labels are combined by node before they are shuffled.
    """
    both = cut(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("component")))
    while True:
        sent = both.join(labels, both.y == labels.k).groupBy("x").agg(F.min("component").alias("m"))
        moved = labels.join(sent, labels.k == sent.x).select("k", F.least("component", "m").alias("component"))
        up = moved.select(F.col("k").alias("component"), F.col("component").alias("top"))
        fresh = cut(moved.join(up, "component", "left").select("k", F.least("component", F.coalesce("top", "component")).alias("component")))
        changed = fresh.alias("a").join(labels.alias("b"), "k").where("a.component <> b.component")
        if changed.isEmpty():
            return fresh
        labels = fresh
