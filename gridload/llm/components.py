"""Connected components of a link table by alternating star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node, label: each linked node and the least node of its component.

    ``links`` has columns a and b. Each turn hangs every node's larger neighbours on its least neighbour, then
    every node's smaller neighbours likewise; the edges become stars after O(log^2 n) turns. A node's
    neighbours are only aggregated and joined (never gathered), and each turn is a staged table.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    edges, seen = stage(edges, "cc-links"), None  # v < u
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))  # u, neighbour v
        # a table of its own: then both sides of the join are plain exchanges, and a node with many neighbours can be split
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = (both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = (hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = stage(small, "cc-turn")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
