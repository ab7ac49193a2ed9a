"""Connected components by alternating stars, on DataFrames of edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (a, b).

    Each round hangs a node's greater neighbours on its least one (large star), then its smaller
    neighbours and itself (small star); the rounds needed grow with the logarithm of the longest path.
    Every round is a table of at most as many edges, written to the shared folder; only its size and a
    checksum come to the driver.  Self-loops and repeated edges are allowed.
    """
    now, last = settled(edges.select("a", "b").where("a != b").distinct(), "edges"), None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        # a table of its own, so that the join after it is between two plain shuffles: a hub's edges can be split
        least = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # now every edge runs from the greater node a to a smaller b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        now = settled(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())
