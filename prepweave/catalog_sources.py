"""Queries over delimited files that are written from the tables: empty lines, folders, quotes over lines; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepweave.registry import register, table
from prepweave.sources import discovery
from prepweave.sources.grid import read_source
from prepweave.tables import fresh_path


def _lines(lines: DataFrame, name: str, order: list[str]) -> str:
    """The column `line` as one text file."""
    path = fresh_path(lines.sparkSession, name)
    lines.orderBy(*order).select("line").coalesce(1).write.text(path)
    return f"{path}/*.txt"


def _two_tables(spark: SparkSession, sf_dir: str) -> str:
    """Customers and below them, after one empty line, suppliers; each with its header."""
    c = table(spark, sf_dir, "customer").select(F.lit(1).alias("part"), F.col("c_custkey").alias("key"), F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("line"))
    s = table(spark, sf_dir, "supplier").select(F.lit(4), F.col("s_suppkey"), F.concat_ws(",", "s_suppkey", "s_name"))
    marks = spark.createDataFrame([(0, 0, "customer,name,segment"), (2, 0, ""), (3, 0, "supplier,name")], "part int, key long, line string")
    return _lines(marks.union(c).union(s), "two-tables", ["part", "key"])


@register(
    """WITH l AS (SELECT 0 AS part, 0 AS key, 'customer' AS a, 'name' AS b, 'segment' AS c UNION ALL SELECT 1, c_custkey, CAST(c_custkey AS VARCHAR), c_name, c_mktsegment FROM customer
  UNION ALL SELECT 2, 0, NULL, NULL, NULL UNION ALL SELECT 3, 0, 'supplier', 'name', NULL UNION ALL SELECT 4, s_suppkey, CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier)
SELECT row_number() OVER (ORDER BY part, key) AS __rn, a AS _c0, b AS _c1, c AS _c2 FROM l"""
)
def source_empty_line(spark, sf_dir):
    """The grid of a file in which an empty line parts two tables: the line is a row, and rows below keep their number."""
    return read_source(spark, _two_tables(spark, sf_dir))


@register(
    """WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s)
SELECT 1 AS first_row, CAST(c + 1 AS BIGINT) AS last_row, 3 AS columns FROM n UNION ALL SELECT c + 3, c + s + 3, 2 FROM n"""
)
def source_regions(spark, sf_dir):
    """The bounds of the two tables that an empty line parts."""
    found = discovery.regions(read_source(spark, _two_tables(spark, sf_dir)))
    return spark.createDataFrame([(r.first_row, r.last_row, r.last_column - r.first_column + 1) for r in found], "first_row long, last_row long, columns int")


@register("SELECT row_number() OVER (ORDER BY s_suppkey) AS __row_id, CAST(s_suppkey AS VARCHAR) AS supplier, s_name AS name FROM supplier")
def source_second_table(spark, sf_dir):
    """The table below the empty line, by its own header."""
    grid = read_source(spark, _two_tables(spark, sf_dir))
    tables = discovery.discover(grid)
    return discovery.read_table(grid, next(t for t in tables if t.region.first_row > 1))


@register("SELECT row_number() OVER (ORDER BY o_orderkey) AS __rn, CAST(o_orderkey AS VARCHAR) AS _c0, o_orderpriority AS _c1, CAST(o_custkey AS VARCHAR) AS _c2 FROM orders")
def source_folder(spark, sf_dir):
    """A folder of five files is one grid, numbered on from file to file."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws(";", "o_orderkey", "o_orderpriority", "o_custkey").alias("line"), "o_orderkey")
    path = fresh_path(spark, "folder")
    o.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").select("line").write.text(path)
    return read_source(spark, f"{path}/*.txt")


@register(
    """WITH l AS (SELECT c_custkey AS key, 0 AS part, CAST(c_custkey AS VARCHAR) AS a, c_name || chr(10) || chr(10) || 'c/o "' || c_mktsegment || '"' AS b, '5" pipe' AS c FROM customer
  UNION ALL SELECT c_custkey, 1, NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 0)
SELECT row_number() OVER (ORDER BY key, part) AS __rn, a AS _c0, b AS _c1, c AS _c2 FROM l"""
)
def source_quoted_breaks(spark, sf_dir):
    """Quoted cells with line breaks and empty lines in them, beside empty lines that are rows and quotes within cells."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("key"), F.lit(0).alias("part"), F.concat("c_custkey", F.lit("|\""), "c_name", F.lit("\n\nc/o \"\""), "c_mktsegment", F.lit("\"\"\"|5\" pipe")).alias("line"))
    return read_source(spark, _lines(rows.union(c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit(1), F.lit(""))), "breaks", ["key", "part"]))
