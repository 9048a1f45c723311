"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (columns a and b, long).

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest (large star, small star), which halves the depth of long chains,
    until a round changes nothing.  Rounds are written to the shared folder; only
    a count and a checksum of the edges come to the driver.  A node that many
    edges meet in is joined by broadcast.  Loops and repeated edges count for nothing.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = cut(hot_join(both, least, "a", "n", 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # a node has as many edges here as stars that it is in
        small = large.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
    tops = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(tops.join(now.select(F.col("a").alias("node")), "node", "left_anti"))
