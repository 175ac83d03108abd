"""Connected components of an edge list that never leaves the cluster.

Alternating large-star and small-star steps on the edges alone: every vertex hands its larger
neighbours the smallest vertex it knows, until all edges point at the smallest vertex of
their component. Each step is two aggregations (combined before the shuffle) and two joins that
adaptive execution may split, so a hub's edges needn't meet in one task. Each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each u with the smallest of its v and itself."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_star(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = _star(large)
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any long ids, loops and repeats allowed -> (node, root), for each node but the roots."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        now = _round(now).checkpoint()
        if (found := mark(now)) == seen:
            break
        seen = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
