"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the component's smallest node.

    Each step groups by node with combining before the exchange and joins back, so a node
    with very many neighbours is a skewed join, not one task. Steps are written tables; the
    loop ends when a step changes nothing, after a number of steps logarithmic in the size.
    """
    current, seen = stored(_smaller(edges), "components"), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
        current = stored(_small_star(_large_star(current)), "components")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _smaller(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller one."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return _smaller(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    to_least = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _smaller(to_least.unionByName(least.select("a", F.col("m").alias("b"))))
