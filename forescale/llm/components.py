"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forescale.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b: long), no self loops needed.

    Each step gives every neighbour of a node a link to the node's smallest neighbour; steps alternate between larger
    and smaller neighbours until all links are stars. A step is a grouped minimum, which combines before the shuffle,
    and a join whose hot nodes adaptive execution splits; the links never grow in number. No node's neighbours meet in one task.
    """
    links = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = mark(links)
    while before[0]:
        links = staged(small_star(large_star(links)), "links")
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them; links go from larger to smaller."""
    least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = links.join(least, F.col("a") == F.col("u"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
