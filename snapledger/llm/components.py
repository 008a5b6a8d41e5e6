"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import settle


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    linked = both.join(least, "a").filter("b > a")
    return linked.select(F.col("b").alias("a"), F.col("low").alias("b"))  # as many rows as there were links


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    linked = edges.join(least, "a")
    down = linked.filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return down.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def finished(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """node, component for every node of the links (a, b); the component is its smallest node.

    Links may be repeated, run either way, or be loops; nodes that only have loops are left out. One yes or no per
    round reaches the driver; every round is stored, so a lost executor repeats at most one.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = settle(edges, "components")
    while not finished(edges):
        edges = settle(small_star(large_star(edges)), "components")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
