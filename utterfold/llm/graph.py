"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), "m")
    return moved.union(least.select("a", "m")).select("a", F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for each node with an edge the least node it is connected to.

    ``edges`` has integer columns ``a, b``, in any direction, repeats allowed. Each round
    is two joins on edges, written out; the number of rounds grows with the logarithm of
    the longest path. No node's neighbours are ever gathered in one place.
    """
    directed = edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = stage(directed.distinct(), "edges")
    before = None
    while True:
        after = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if after == before:
            break
        before = after
        large = _large_star(current).where("a != b").distinct()
        current = stage(_small_star(large).where("a != b").distinct(), "edges")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
