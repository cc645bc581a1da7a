"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import prepare


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("x", "y")
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.toDF("u", "v"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a centre without an edge to a smaller node, or has one such edge and no other."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("centre")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    roles = ends.groupBy("x").agg((F.sum("up") + F.max("centre")).alias("roles"))
    return roles.filter("roles > 1").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the link table (a, b); the component is its smallest node.

    Links are undirected; loops and repeated links do no harm; nodes without a link to another are
    not returned. Every step is a join on nodes, never a list of one node's neighbours, and each
    round is checkpointed. The loop ends when only stars are left, which a round would not change.
    """
    prepare(links.sparkSession)
    edges = (
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )
    while not _stars(edges):
        edges = _small_star(_large_star(edges).distinct()).distinct().checkpoint()
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct())
