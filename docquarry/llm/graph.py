"""Connected components of undirected graphs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import cut


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and its neighbours. All pairs of a u, two numbers each, meet in one task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    own = starred.select("u", "m").distinct().select("u", F.col("m").alias("v"))
    rest = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(rest).distinct()


def _state(edges: DataFrame) -> Row:
    """A checksum of distinct edges; exclusive or, unlike a sum, cannot overflow however many there are."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v long); the root is the component's least node.

    Each round makes the paths to the root shorter by a factor, and its edges
    are cut off from their lineage in the checkpoint folder. Loops and
    repeated edges do not matter; null ends are dropped.
    """
    now = cut(edges.where("u <> v").select("u", "v").distinct())
    before = None
    while True:
        state = _state(now)
        if state == before:
            break
        before = state
        now = cut(small_star(large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
