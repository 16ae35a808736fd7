"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.session import discard, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    root = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionByName(root.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; component is its smallest node.

    Self-loops, repeated edges and either orientation are fine; null ends are ignored.
    Each round is written to the shared folder, so lineage stays short; only two
    numbers a round reach the driver. Rounds grow with the logarithm of the longest path.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "components")
    state = None
    for _ in range(max_rounds):
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state, before = seen, current
        current = materialise(_stars(before), "components")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
