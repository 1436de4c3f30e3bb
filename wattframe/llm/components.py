"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.scratch import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    around = _both_ways(edges)
    least = scratch.keep(around.groupBy("a").agg(F.min("b").alias("least")))
    larger = around.where("b > a").join(least, "a")
    out = larger.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
    kept = scratch.keep(out)
    scratch.drop(least)
    return kept


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.keep(down.groupBy("a").agg(F.min("b").alias("least")))
    moved = down.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    kept = scratch.keep(moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct())
    scratch.drop(least)
    return kept


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of every node in ``edges(a, b)`` but the roots; the root is the least node.

    The number of rounds grows with the logarithm of the nodes. Minima are combined
    before the shuffle, and links are brought together with them by plain joins that
    adaptive execution can split where one node has very many links.
    """
    current = scratch.keep(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        large = _large_star(current, scratch)
        scratch.drop(current)
        current = _small_star(large, scratch)
        scratch.drop(large)
        seen = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if tuple(seen) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
