"""Connected components of links, on DataFrames: stars are drawn together until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(links: DataFrame, kept: Scratch) -> DataFrame:
    """(node, label) for each end of ``links`` (a, b: long): the label is the smallest node that can be reached.

    In each round every node hands its larger neighbours, and then its smaller ones, to
    the smallest node it knows. Rounds grow with the logarithm of the longest path. Each
    round is a table of ``kept``; only two numbers of it go to the driver. The smallest
    neighbours are a table of their own, so that joins can split a node of many neighbours.
    """
    now = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        with Scratch(links.sparkSession) as round_:
            both = now.union(now.select("v", "u")).toDF("x", "y")
            least = round_(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
            large = round_(both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")))
            best = round_(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(best, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = kept(small.union(best.toDF("u", "v")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.toDF("node", "label").union(now.select("v", "v").distinct())
