"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._scratch import Scratch, spread_join


def connected_components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has an edge to another; the root is the component's smallest node.

    ``edges``: two columns ``a, b`` of one orderable type, in either direction, repeats and loops allowed.  Large-star
    and small-star steps alternate until nothing changes, in a number of rounds logarithmic in the longest path.  A
    node's smallest neighbour is an aggregate, combined before it is shuffled; it is joined back to the node's edges by
    ``spread_join``, which deals a hub's edges out to many tasks.
    """
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        # Stars have nothing left to do: no node is a member twice, or a member and a centre.
        roles = now.select(F.col("a").alias("node"), F.lit(1).alias("k")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("k")))
        roles = roles.groupBy("node").agg(F.sum("k").alias("member"), F.min("k").alias("least"))
        if roles.filter("member > 1 OR (member = 1 AND least = 0)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = spread_join(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = scratch.save(large)
        # Small star: every smaller neighbour of a node, and the node, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now, large)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
