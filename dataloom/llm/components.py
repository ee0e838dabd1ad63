"""Connected components of a link table by alternating star steps.

Both steps only ever look at a node's smallest neighbour, which a grouping finds with
partial aggregation, so a node with very many links is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dataloom.plans.shared import stored


def _hung(links: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of a node moves to the node's smallest one."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    return (
        both.join(least, "a").where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
    )


def _tied(links: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours move to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionAll(least.select("a", F.col("low").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on another node."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(
        links.select(F.col("b").alias("node"), F.lit(0), F.lit(1))
    )
    found = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return found.where("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links(a, b)``; the root is the smallest node.

    Links may repeat, point either way or to the node itself. Nodes without a link to
    another node are not in the result; no links give no rows. Every round is written
    to the shared folder, so a lost executor repeats one round at most.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    while not _settled(edges):
        edges = stored(_tied(_hung(edges)), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
