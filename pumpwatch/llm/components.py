"""Connected components by alternating large-star and small-star passes.

Each pass is a partial ``min`` per vertex and a join on the vertex, so a
vertex with very many neighbours is pre-aggregated before it is shuffled and
its join partition can be split. Every pass ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.llm.common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Vertices of ``edges`` (u, v) with the smallest vertex they reach.

    Returns (vertex, root) for every vertex that has an edge to another and is
    not the root itself. Loops and repeated edges are allowed; no edges give
    no rows. The number of passes is logarithmic in the longest chain.
    """
    edges = checkpoint(edges.where("u != v").distinct())
    before = _state(edges)
    while True:
        edges = checkpoint(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        before = after
