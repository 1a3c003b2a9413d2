"""Connected components of an edge table, as Spark joins only; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (a, b), a > b, is the larger end of one edge only, or the smaller end of some."""
    ends = edges.select("a", F.lit(1).alias("larger"), F.lit(0).alias("smaller")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("a").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller"))
    return not nodes.agg(F.count_if(F.expr("larger > 1 OR (larger = 1 AND smaller = 1)"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b): the smallest node it is connected with.

    Alternates large-star and small-star steps: each round links every node's larger (or smaller and equal)
    neighbours to its smallest one, which at least halves paths, until the edges are stars around smallest nodes. Null
    ends and loops are ignored. A node with many edges is an aggregate with partial sums and a join that AQE can split.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while not _are_stars(now):  # each round makes paths shorter, so this ends
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written down, so that the join is of two plain shuffles: AQE then splits a node with many edges
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        now = cut(small)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
