"""Connected components of a link table by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: links each larger (or, at the small star, smaller) neighbour of a node to the least of its neighbourhood."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of the links (u, v); root is the least node reachable.

    The rounds end when the links no longer change; each round's links are a table in the shared folder. The number of
    rounds grows with the logarithm of the longest path. Nodes without a link are not returned.
    """
    edges = stage(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    before = None
    for _ in range(most):
        old, edges = edges, stage(_star(_star(edges, True), False), "links")
        unstage(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
