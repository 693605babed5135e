"""Connected components of link tables, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _open_nodes(edges: DataFrame) -> int:
    """Nodes that keep the links (u, v) from being stars: with several v, or a v somewhere and a u elsewhere."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 OR up > 0 AND down > 0"))).first()[0]


def connected_components(links: DataFrame) -> DataFrame:
    """Links (u, v) to (id, component): every linked id with the smallest id it reaches.

    Large-star and small-star steps by turns until all links form stars, which takes about log(n) rounds and
    keeps at most as many rows as there are links. Hot ids are pre-aggregated (min) before the shuffle; in the
    joins back to their links, where one side has one row for each id, adaptive execution splits the rows of hot ids
    (or broadcasts that side), which takes no job of its own. Every round is written to the shared folder, so a lost
    executor costs one round at most. Self-links and repeated links are fine; an empty table gives an empty one.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = materialize(edges, "links")
    while _open_nodes(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
