"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node of each component, for ``nodes(node)`` and ``edges(src, dst)``.

    Alternating stars (Kiveris et al., "Connected components in MapReduce and beyond", 2014): the
    minimum per node is combined before the shuffle, and the number of rounds grows with the
    logarithm of the graph. Every round goes through written files.
    """
    stars = cut_lineage(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        stars = cut_lineage(_small_star(_large_star(stars)), replaces=stars)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.join(stars, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
