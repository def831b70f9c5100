"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregate (partial sums before the shuffle), written to the shared folder, and a join with it on a
node; so a hub's edges are never gathered in one row, and Spark can split them over tasks. Nothing is broadcast: files of
edges are much smaller than their rows. Edges may repeat; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, written


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the edges a, b (longs): root is the smallest node of its component."""
    e = written(edges.select("a", "b").where(F.col("a") != F.col("b")), "edges")
    was = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            break
        was = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(shuffled(least), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(shuffled(least), "a")
        own = least.select("a", F.col("m").alias("b"))
        e = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).union(own).distinct(), "edges")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
