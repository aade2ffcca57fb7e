"""Connected components by alternating stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node that it reaches, for every node with an edge to another.

    Repeated edges, loops and edges with a null play no part. Each round links neighbours to the least one among them, first
    the greater neighbours of a node, then the smaller ones; after a few rounds (logarithmic in the longest chain) every
    node hangs on its root alone. Edges that do so from the start need no round. Only a count reaches the driver.
    """
    oriented = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = settle(oriented, "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Tables between: a node of very many edges is then split over tasks when it meets its least neighbour.
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = settle(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges"
        )
        lowest = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and is nobody's ``v``; edges are distinct and ``u`` > ``v``, so each ``v`` is then the least of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("hung")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("own"), F.lit(1).alias("hung"))
    )
    nodes = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("hung").alias("hung"))
    return nodes.agg(F.count_if((F.col("own") > 1) | (F.col("own") == 1) & (F.col("hung") == 1))).first()[0] == 0
