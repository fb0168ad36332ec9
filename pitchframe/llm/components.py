"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import settle


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the smallest of u and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are joined to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    below = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v); a component is named by its smallest node.

    Each pair of steps is a written table; the steps end when one leaves the edges as they were.  The
    number of steps grows with the logarithm of the longest path.
    """
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("mark")
    edges, seen = settle(edges.where("u <> v").distinct(), "edges"), None
    while True:
        row = edges.agg(F.count("*").alias("n"), mark).first()
        if tuple(row) == seen:
            break
        seen = tuple(row)
        edges = settle(_small_star(_large_star(edges)).distinct(), "small")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
