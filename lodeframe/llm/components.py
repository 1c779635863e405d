"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every linked node but the components' own smallest nodes.

    ``edges`` has long columns a, b in any direction, repeats and loops allowed. Each round hangs
    every neighbourhood on its minimum, with partial aggregation before the shuffle and joins that
    adaptive execution can split, so that a hub is not gathered in one task. The rounds grow with the
    logarithm of the longest path; each is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if seen["n"] == 0 or state == (seen["n"], seen["h"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = (seen["n"], seen["h"])
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # the minima are a table of their own: a join of two plain exchanges can be split where a hub is
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
