"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """(node, least): the least of each node's neighbours and itself. Stored, so that a join with it can split a node with many edges."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each v has one centre and no centre is itself a v."""
    twice = edges.groupBy("u").count().filter("count > 1")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return twice.isEmpty() and chained.isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its least node.

    Large-star and small-star steps alternate until each component is a star around its least node, which takes about log(nodes) rounds.
    Each step moves every edge once; nothing but two yes-or-no answers a round reaches the driver.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    for _ in range(rounds):
        if _is_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_stars(both, "large"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large-edges")  # every u is larger than its v
        least = _stars(large, "small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")).filter("u <> v")).distinct()
        e = stored(small, "small-edges")
    else:
        raise RuntimeError("the components did not settle")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
