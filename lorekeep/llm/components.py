"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import stored


def _fewest(links: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """The smallest partner of each node; stored, so that the join that follows
    shuffles both of its sides and splits a hub's links where needed."""
    return stored(links.groupBy(key).agg(F.min(other).alias("least")), name)


def same_id_links(rows: DataFrame, id_col: str, node: str) -> DataFrame:
    """Links (``node``, ``root``) between the nodes that rows with one id belong to."""
    pairs = rows.where(F.col(id_col).isNotNull()).groupBy(id_col, node).agg(F.lit(1).alias("one"))
    several = pairs.groupBy(id_col).agg(F.min(node).alias("root"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(several, id_col).select(F.col(node).alias("node"), "root")


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """Component (its smallest node) of every node that has a link to another.

    Large and small star steps in turn: first the larger partners of each node,
    then the smaller ones, are tied to the smallest of them.  The rounds needed
    grow with the logarithm of the longest path.  Returns ``node`` and
    ``component``.  Links with a null or to the node itself count for nothing.
    """
    u, v = F.col("u"), F.col("v")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stored(edges.where(u > v).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(u.alias("node"), v.alias("component")).union(
                edges.select(v.alias("node"), v.alias("component"))
            ).distinct()
        seen = now
        both = edges.union(edges.select(v.alias("u"), u.alias("v")))
        least = _fewest(both, "u", "v", "least")
        large = stored(
            both.where(v > u).join(least, "u").select(v.alias("u"), F.least("least", "u").alias("v")).distinct(), "large"
        )
        least = _fewest(large, "u", "v", "least")
        small = large.join(least, "u").where(v != F.col("least")).select(v.alias("u"), F.col("least").alias("v"))
        small = small.union(least.select("u", F.col("least").alias("v"))).where(u > v)
        edges = stored(small.distinct(), "links")
