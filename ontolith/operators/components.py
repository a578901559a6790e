"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontolith.plans.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every id in links (a, b) that is not only linked to itself: the smallest id that can be reached.

    Large-star links a node's greater neighbours to its least one, small-star its lesser ones; both are a minimum by key and a
    join. Minima are written before they are joined, so that the join is between two plain exchanges and a hub with many
    links can be split. Each round is written; only a count and a checksum come to the driver.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    k = 0
    while not _are_stars(edges):
        k, n = k + 1, 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{k}-large", n)
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(moved.where("u != v").distinct(), f"{name}-{k}-edges", n)
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}-small", n)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        new = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}", n)
        scratch.drop(f"{name}-{k}-large", f"{name}-{k}-edges", f"{name}-{k}-small", f"{name}-{k - 1}")
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour at most and that one has none: u -> v then is the component."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi")
    return several.unionByName(inner).isEmpty()
