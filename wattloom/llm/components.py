"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge of (a long, b long); the label is the component's smallest node.

    Rows stay proportional to the edges in every round, so a hub with a third of all nodes costs one row per
    neighbour. Each round is cut off by a checkpoint. Edges from a node to itself are ignored; no edges, no rows.
    """
    edges = cut_lineage(edges.filter("a != b").distinct())
    seen = None
    for _ in range(max_rounds):
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    children = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return children.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
