"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridterrain.operators.skew import join_unique, join_written, shares
from gridterrain.scratch import materialise, release


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _lowest(edges: DataFrame) -> DataFrame:
    """Lowest neighbour and degree of each ``u``, and whether it is neither a root nor tied to one alone; pre-aggregated in every task."""
    lower = F.count_if(F.col("v") < F.col("u"))
    loose = (lower > 0) & (F.count("*") > 1)
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"), loose.alias("loose"))


def _large_star(edges: DataFrame, lowest: DataFrame, sums: tuple[int, int, int]) -> DataFrame:
    """Connect each larger neighbour of a node to the lowest of its neighbourhood."""
    lowest = lowest.select("u", F.least("u", "m").alias("m"), "degree")
    higher = _both(edges).filter("v > u")
    return join_written(higher, lowest, ["u"], "degree", *sums).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the lowest of them; edges point downwards."""
    lowest = _lowest(edges).drop("loose")
    moved = join_unique(edges, lowest, ["u"], "degree").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)`` that is not its component's lowest.

    The rounds grow with the logarithm of the component size, not with its diameter. Each round's
    edges are written once, which cuts the lineage and survives lost executors, and those of the round
    before are deleted; the only values that reach the driver are counts. No node is loose once every
    one is a root or tied to its root alone. A hot node's edges are never gathered in one task.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    current, path = materialise(edges.select(high, low).filter("u <> v").distinct(), "stars")
    while True:
        lowest, lowest_path = materialise(_lowest(_both(current)), "lowest")
        *sums, loose = lowest.agg(*shares("degree"), F.count_if("loose")).first()
        if not loose:
            release(spark, lowest_path)
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # The small star reads the large one several times.
        large, large_path = materialise(_large_star(current, lowest, sums), "stars")
        current, made = materialise(_small_star(large), "stars")
        for done in (path, large_path, lowest_path):
            release(spark, done)
        path = made
