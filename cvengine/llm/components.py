"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvengine.llm.common import stage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b: long), component = smallest node reachable.

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). The links stay distributed; each
    round is staged in the shared folder. Smallest neighbours come from a pre-aggregated count by node and are
    staged before they are joined, so that adaptive execution may split the links of a hub. NULL ends and
    loops are ignored; without links the result is empty.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = _print(edges)
    while True:
        edges = stage(_small_star(_large_star(edges)), "links")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionAll(roots)


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = stage(both.groupBy("u").agg(F.min("v").alias("m")), "lowest").withColumn("m", F.least("u", "m"))
    linked = both.where("v > u").join(lowest, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    edges = stage(edges, "large-star")
    lowest = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    linked = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()
