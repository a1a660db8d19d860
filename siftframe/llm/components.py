"""Connected components: pointer jumping in a forest, star joins in any graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import stage


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) of every node of a forest (a, b): one row for each a, its parent b smaller than a.

    Each round replaces a node's parent by its grandparent, so a path of d
    links takes about log2(d) joins; AQE splits them on hot parents.
    """
    p = parents.select("a", "b")
    while True:
        up = p.select(F.col("a").alias("b"), F.col("b").alias("c"))
        moved = p.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved"))
        p = stage(moved, "parents")
        if p.where("moved").isEmpty():
            return p.select(F.col("a").alias("node"), F.col("b").alias("component")).union(p.select("b", "b").distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether every u of the edges (u, v) has one v, and none of these is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).union(
        e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return ends.where("as_u > 1 or (as_u = 1 and as_v = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b of long); component is its smallest node.

    Large-star and small-star joins by turns. Each round keeps at most as many
    edges as the one before; a hub's rows are pre-aggregated to its minimum
    before the shuffle and AQE splits the joins on hot nodes. Rounds end when
    the edges are stars around smallest nodes. Loops and repeated edges are
    allowed; a node with a loop only is not returned.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stage(e, "edges")
    while not _are_stars(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v")
        e = stage(small.distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
