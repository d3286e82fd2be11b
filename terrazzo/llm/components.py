"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round takes minima with a grouped aggregate and joins them back; no task gathers a node's
neighbours, and nothing reaches the driver but whether a round was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a root or hangs on one root by one link."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller (small) neighbours to the least node it sees."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    seen = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "__a")
    joined = both.join(seen, both.a == seen["__a"]).drop("__a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(seen.select(F.col("__a").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(a, b): every node a that is not the least of its component, with that least node b.

    links has the columns a and b, ids in any order; loops and repeats do no harm.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    for _ in range(limit):
        if _settled(edges):
            return edges
        edges = stored(_star(_star(edges, True), False), "links")
    raise RuntimeError("components did not settle")
