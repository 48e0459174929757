"""Connected components of a link table, by alternating large and small stars.

Each step is a ``min`` aggregate (merged before the shuffle) and a join of two
staged tables, which adaptive execution splits where a hub has many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link every larger neighbour of u to the smallest node near u.
    Small star: the same for the smaller neighbours and u itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    near = near.where("u <> v")
    low = stage(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    moved = near.join(low.hint("merge"), "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) -> (node, component), one row per node that has a link;
    the component is named by its smallest node. Null ends are left out."""
    edges = stage(links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "links")
    last = None
    while True:
        edges = stage(_star(stage(_star(edges, True), "large"), False), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
