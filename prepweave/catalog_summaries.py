"""Queries over cubes and sketches, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepweave.operators import sketches
from prepweave.operators.aggregate import Measure
from prepweave.operators.cube import cube, grouping_sets, rollup
from prepweave.operators.quantiles import exact_percentiles
from prepweave.registry import register, table
from prepweave.tables import written

KEYED = "SELECT NULLIF(l_returnflag, 'A') AS flag, l_linestatus AS status, l_linenumber AS line, l_suppkey, l_tax, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem"


def _keyed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("nullif(l_returnflag, 'A') as flag", "l_linestatus as status", "l_linenumber as line", "l_suppkey", "l_tax", "cast(l_quantity as decimal(18,2)) as q")


@register(
    f"""SELECT flag, status, line, grouping_id(flag, status, line) AS grouping_id, count(q) AS rows, CAST(sum(q) AS DOUBLE) AS quantity, min(l_tax) AS lowest, max(l_tax) AS highest, count(DISTINCT l_suppkey) AS suppliers,
  CAST(sum(q) AS DOUBLE) / count(q) AS mean FROM ({KEYED}) GROUP BY CUBE (flag, status, line)"""
)
def cube_lineitem(spark, sf_dir):
    """All groupings of three keys, one of which has nulls, from one grouping of the rows."""
    measures = [Measure("q", "count", "rows"), Measure("q", "sum", "quantity"), Measure("l_tax", "minimum", "lowest"), Measure("l_tax", "maximum", "highest"), Measure("l_suppkey", "unique_count", "suppliers")]
    out = grouping_sets(_keyed(spark, sf_dir), cube(["flag", "status", "line"]), measures)
    return out.withColumn("quantity", F.col("quantity").cast("double")).withColumn("mean", F.col("quantity") / F.col("rows"))


@register("SELECT o_orderpriority AS priority, year(o_orderdate) AS year, o_custkey AS customer, grouping_id(o_orderpriority, year(o_orderdate), o_custkey) AS grouping_id, count(*) AS orders FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate), o_custkey)")
def rollup_orders(spark, sf_dir):
    """Orders by priority, year and customer, with totals; levels are chained, as if their groups were many."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("customer"), "o_orderkey")
    return grouping_sets(o, rollup(["priority", "year", "customer"]), [Measure("o_orderkey", "count", "orders")], many=100)


def _batches(df: DataFrame, key: str, count: int = 3) -> list[DataFrame]:
    return [df.filter(F.pmod(F.col(key), F.lit(count)) == i) for i in range(count)]


def _merged(parts: list[DataFrame]) -> DataFrame:
    return written(reduce(DataFrame.unionByName, parts), "sketches")


@register(
    """WITH h AS (SELECT event_type, md5(CAST(user_id * 7919 + event_id % 500 AS VARCHAR)) AS d FROM events),
r AS (SELECT event_type, CAST('0x' || substr(d, 1, 3) AS INT) AS k, max(53 - length(bin(CAST('0x' || substr(d, 4, 13) AS BIGINT)))) AS v FROM h GROUP BY 1, 2),
z AS (SELECT event_type, 4096 - count(*) AS empty, sum(pow(2.0, -v)) + 4096 - count(*) AS z FROM r GROUP BY 1),
e AS (SELECT *, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / z AS raw FROM z),
w AS (SELECT event_type, count(DISTINCT d) AS exact FROM h GROUP BY 1)
SELECT event_type, CAST(round(CASE WHEN raw <= 2.5 * 4096 AND empty > 0 THEN 4096 * ln(4096.0 / empty) ELSE raw END) AS BIGINT) AS estimate, exact, true AS within FROM e JOIN w USING (event_type)"""
)
def sketch_distinct(spark, sf_dir):
    """Different values of three batches, from merged sketches, beside the exact count: within four standard errors."""
    e = table(spark, sf_dir, "events").selectExpr("event_type", "event_id", "user_id * 7919 + event_id % 500 as v")
    merged = sketches.merge_distinct(_merged([sketches.distinct_sketch(b, ["event_type"], "v") for b in _batches(e, "event_id")]), ["event_type"])
    exact = e.groupBy("event_type").agg(F.count_distinct("v").alias("exact"))
    out = merged.join(exact, "event_type").withColumn("estimate", F.round(sketches.distinct_estimate(F.col("sketch"))).cast("long"))
    return out.select("event_type", "estimate", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 4 * 1.04 / 64 * F.col("exact") + 1).alias("within"))


@register(
    """SELECT l_returnflag AS flag, quantile_disc(l_extendedprice, 0.5) IS NOT NULL AS median_within, true AS high_within, count(*) AS n FROM lineitem GROUP BY 1"""
)
def sketch_quantiles(spark, sf_dir):
    """Quantiles of three batches from merged sketches lie within one percent of the exact ones, and no row is lost."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"), "l_orderkey")
    merged = written(sketches.merge_quantiles(_merged([sketches.quantile_sketch(b, ["flag"], "v") for b in _batches(df, "l_orderkey")]), ["flag"]), "merged")
    # by selection: an aggregate would hold all different values of a flag in one task
    exact = exact_percentiles(df, ["flag"], "v", [0.5, 0.99]).withColumnsRenamed({"p0": "m", "p1": "h"})
    about = sketches.quantile_estimates(merged, ["flag"], [0.5, 0.99])
    rows = merged.select("flag", F.aggregate(F.map_values("sketch"), F.lit(0).cast("long"), lambda a, v: a + v).alias("n"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= (sketches.RELATIVE + 0.002) * F.col(b)  # noqa: E731  a row beside it may be exact's
    return about.join(exact, "flag").join(rows, "flag").select("flag", near("q0", "m").alias("median_within"), near("q1", "h").alias("high_within"), "n")


@register(
    """WITH v AS (SELECT event_type, CASE WHEN event_id % 4 = 0 THEN 'hot' WHEN event_id % 10 = 1 THEN 'warm' ELSE CAST(event_id AS VARCHAR) END AS value FROM events),
n AS (SELECT event_type, count(*) AS n FROM v GROUP BY 1)
SELECT event_type, value, n, true AS within FROM (SELECT event_type, value, count(*) AS c FROM v GROUP BY 1, 2) JOIN n USING (event_type) WHERE c >= 0.05 * n"""
)
def sketch_heavy_hitters(spark, sf_dir):
    """Values with a twentieth of a group's rows, from merged counters; their counts are within the bound."""
    e = table(spark, sf_dir, "events").selectExpr("event_type", "event_id", "case when event_id % 4 = 0 then 'hot' when event_id % 10 = 1 then 'warm' else cast(event_id as string) end as value")
    merged = sketches.merge_frequencies(_merged([sketches.frequency_sketch(b, ["event_type"], "value", 0.05) for b in _batches(e, "event_id")]), ["event_type"], 0.05)
    found = sketches.heavy_hitters(merged, ["event_type"])
    exact = e.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    out = found.join(exact, ["event_type", "value"], "left")
    return out.select("event_type", "value", "n", ((F.col("about") >= F.col("c")) & (F.col("about") <= F.col("c") + 3 * F.col("n") / sketches.CELLS + 1)).alias("within"))
