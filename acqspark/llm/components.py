"""Connected components by alternating large-star and small-star steps: edges
are rewritten towards the smallest neighbour until each node hangs on its
component's smallest node. Nothing is gathered on the driver but a flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _towards(arcs: DataFrame, least: DataFrame) -> DataFrame:
    return arcs.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-min")
    return staged(_towards(arcs.where("v > u"), least), "star")


def _small_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = staged(arcs.groupBy("u").agg(F.min("v").alias("m")), "star-min")
    # the node itself is moved along with its smaller neighbours
    return staged(_towards(arcs, least).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one other node that hangs on none: the edges
    (u, v) with v < u are then their components' stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.where("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in the edges (u, v), root being the smallest
    node of its component. The number of rounds grows with the logarithm of
    the longest chain."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = staged(edges.distinct(), "edges")
    while not _settled(edges):
        edges = _small_star(_large_star(edges))
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
