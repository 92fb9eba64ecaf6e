"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)``, one integer or string type -> ``(node, component)``: the smallest node reachable.

    Only nodes that have an edge to another node are returned. Every round aggregates a minimum per node
    (partial aggregation before the shuffle) and joins it back; a hub's rows meet in a join that Spark can
    split, never in one task's memory. Nothing is collected but the number of edges that still change.
    An empty table gives an empty result; self-loops and repeated edges change nothing.
    """
    now = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        after = cut(small, "cc-edges")
        discard(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:  # a fixed point: the same set of edges
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    parents = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return parents.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Number of different edges and two sums of their hashes, in one pass without a shuffle of rows."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.sum(F.xxhash64(h).cast("decimal(20,0)"))).first())
