"""Connected components by alternating large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepweave.llm.common import dropped, written


def _oriented(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _oriented(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _oriented(edges.join(least, "u").select("v", "m").toDF("u", "v").unionByName(least.toDF("u", "v")))


def components(edges: DataFrame) -> DataFrame:
    """For edges u, v the smallest vertex of each vertex's component: columns vertex, component, without the smallest
    vertices themselves. Each round is written; the edges at most shrink, and the driver sees their count and sum only."""
    seen, now = None, written(_oriented(edges), "edges")
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.toDF("vertex", "component")
        old, seen, now = now, mark, written(_small_star(_large_star(now)), "edges")
        dropped(old)
