"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the least node of its component.

    Links are rewired to the least neighbour, first those of larger nodes, then those of smaller ones, until
    every component is a star; the number of rounds grows with the logarithm of its size. A node
    with very many links is met by one row, its least neighbour.
    """
    nodes = cut_lineage(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = cut_lineage(now), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
