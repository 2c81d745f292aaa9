"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node points to one other at most, and none that points is pointed to."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as longs -> (node, component): component is the smallest node reachable.

    Each step is a minimum per node, pre-aggregated before its shuffle, and a join back that
    adaptive execution may split at a hub; no neighbourhood is collected. A side is broadcast only
    where its size, which the optimizer knows from the table or at run time, is below its threshold. Steps are a few times
    the logarithm of the longest path, and end when only stars are left. Loops and nulls are dropped;
    no edges, no rows.
    """
    edges = durable(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, durable(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(old)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
