"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import stored


def _stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) hangs a node u on a root: u is in no other edge, v on nothing."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    ends = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.where(F.col("down") + F.col("up") > 1).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of `links` (a, b) that reach a smaller one, root being the
    smallest; every other node is its own root.

    A round hangs every node's larger neighbours, then its smaller ones, on the smallest of
    them; the edge list never grows, and rounds end when only stars are left. Minima are
    aggregated before the shuffle, and a node with very many neighbours is an ordinary skewed
    side of a join. Each round is written to the shared folder.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
