"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.storage import discard, stored


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges`` (src, dst: long) to (node, component): the smallest node that can be reached.

    Only nodes that have an edge to another node are returned; nulls and loops are ignored. Each step is two
    aggregations and joins on the node, so a hub of millions of edges is combined before the shuffle and split by
    adaptive execution after it; no neighbour list is gathered. Each step's edges are a table in the shared folder.
    """
    now = stored(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        label,
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, label)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(turned.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), label)
        discard(large)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
