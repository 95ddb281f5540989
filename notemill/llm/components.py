"""Connected components by alternating large-star and small-star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(id, component) of every node that has a link; component is the smallest id that can be reached.

    Each round joins the links with the least neighbour of each node, a table of one row a node, so a node with very
    many links is an ordinary skewed join that adaptive execution splits. Each round is written to the shared folder.
    Null ends and loops are left out. The stars no longer change after O(log^2 n) rounds; more than max_rounds is an
    error, never a partial result.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(edges.where("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
            ).groupBy("id").agg(F.min("component").alias("component"))
        mark = now
        edges = cut(_small_star(_large_star(edges).distinct()).distinct())
    raise RuntimeError(f"the components are not stable after {max_rounds} rounds")
