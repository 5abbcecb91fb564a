"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import forget, settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each linked node's component, by alternating large and small stars.

    Both stars are aggregates of minima and joins with them, so a node of very
    many links is never gathered; rounds grow with the logarithm of the
    longest path.  Lineage is cut after every round.
    """
    edges = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), True)
    while not _is_stars(edges):
        # Large star: each neighbour above a node links to the least of the node and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), True)
        large = settled(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), True)
        forget(edges, least)
        # Small star: a node and its neighbours below it link to the least of them.
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")), True)
        down = large.join(least, "u")
        edges = settled(down.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), True)
        forget(large, least)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _is_stars(edges: DataFrame) -> bool:
    """Does every upper end have one edge, and is no lower end an upper one?"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()
