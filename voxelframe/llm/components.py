"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours its smallest neighbour (itself included)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself its smallest neighbour; ``a > b`` holds on the way in."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``edges``: two columns of one orderable type, in any direction, repeated or looped edges allowed.

    Returns (node, root), one row per node with an edge to another node; root is the smallest node reachable. Each
    round is a written table, so lost executors cost one round at most. Raises if ``most_rounds`` don't suffice
    (the number of rounds grows with the logarithm of the longest path).
    """
    a, b = edges.columns
    now = materialize(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges"
    )
    for _ in range(most_rounds):
        now = materialize(_small_star(materialize(_large_star(now).where("a <> b").distinct(), "large")).where("a <> b").distinct(), "small")
        # Settled: every node has one neighbour below it, which has none.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(now.select("b", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if nodes.where("below > 1 OR below = 1 AND above = 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
