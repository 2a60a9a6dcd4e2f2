"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import pin

#: Rounds roughly double the distance over which labels meet, so this is far beyond any real graph.
MOST_ROUNDS = 60


def starred(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (``large``) or smaller neighbours to the least node around it. ``edges``: a > b."""
    if large:
        around = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        around = edges.toDF("u", "v")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    moved = joined.filter("v > u").select("v", "m") if large else joined.select("v", "m").union(least.select("u", "m"))
    return moved.toDF("a", "b").filter("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``links`` (a, b), by alternating stars.

    Each round's edges are checkpointed; nothing but their count and checksum reaches the driver. Minima are combined
    before the shuffle, and a node with very many links is split by Spark's skew join.
    """
    edges = pin(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = pin(starred(starred(edges, True), False))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
