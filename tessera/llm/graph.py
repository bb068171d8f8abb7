"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """edges: distinct u, v with u > v. Whether every u has one v, and no v is a u as well."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). (v, c) for every vertex of an edge, c the least vertex of its component.

    Every round is written to the shared folder; hot vertices meet their minimum in a join
    of two written tables, which adaptive execution can split. Rounds go on until all edges are
    stars around their components' least vertices, which a further round would leave as they are;
    their number grows with the logarithm of the vertices, not their chains' lengths. What a round
    asks is one query: plans, threads and listeners of many small ones add up in the driver."""
    with Scratch(edges.sparkSession) as work:
        now = work.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
        while not _are_stars(now):
            before = now
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = work.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = work.keep(large.where("u <> v").distinct(), "large")
            work.drop(least)
            least = work.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            now = work.keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
            work.drop(least, large, before)
        ends = now.select(F.col("v").alias("v"), F.col("v").alias("c")).distinct()
        return work.release(now.select(F.col("u").alias("v"), F.col("v").alias("c")).union(ends))
