"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def components(edges: DataFrame, rows: int, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node with an edge; there are at most ``rows`` edges.

    Every step is a minimum per node, which is summed in parts, and a join with it that Spark can split; so a node
    with very many edges is not brought into one task. Edges stay at most as many as given, and the number of steps
    grows with the logarithm of the longest path.
    """
    now = edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where("low <> high").distinct()
    now = settle(now, "edges", rows)
    mark = None
    while True:
        # Large star: of the neighbours of a node, those above it move to the smallest one.
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct()
        large = settle(large, "large", rows)
        # Small star: a node and its neighbours below it move to the smallest one.
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select(
            F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high")
        ).where("low <> high").distinct()
        now = settle(small, "small", 2 * rows)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("low", "high"))).head()
        if state == mark:
            break
        mark = state
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(
        now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
