"""Queries that compare, match and check tables, and read nested records; with their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from prepweave.operators import compare, fuzzy, integrity
from prepweave.registry import register, table
from prepweave.sources import catalog as files
from prepweave.sources import nested
from prepweave.tables import fresh_path, written

# --- two versions of a table

_OLD = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price, NULLIF(o_orderpriority, '5-LOW') AS priority FROM orders WHERE o_orderkey % 97 <> 5"
_NEW = """SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 3 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus,
  CAST(CAST(CASE WHEN o_orderkey % 53 = 9 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(18,2)) AS VARCHAR) AS price,
  CASE WHEN o_orderkey % 61 = 7 THEN NULL ELSE NULLIF(o_orderpriority, '5-LOW') END AS priority FROM orders WHERE o_orderkey % 89 <> 11"""
_COMPARED = ("o_custkey", "o_orderstatus", "price", "priority")


@register(
    f"WITH a AS ({_OLD}), b AS ({_NEW}), j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS x, b.o_orderkey AS y, "
    + ", ".join(f"CAST(a.{c} AS VARCHAR) AS a_{c}, CAST(b.{c} AS VARCHAR) AS b_{c}" for c in _COMPARED)
    + " FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) SELECT o_orderkey, 'added' AS change, NULL AS column, NULL AS before, NULL AS after FROM j WHERE x IS NULL UNION ALL SELECT o_orderkey, 'removed', NULL, NULL, NULL FROM j WHERE y IS NULL"
    + "".join(f" UNION ALL SELECT o_orderkey, 'changed', '{c}', a_{c}, b_{c} FROM j WHERE x IS NOT NULL AND y IS NOT NULL AND a_{c} IS DISTINCT FROM b_{c}" for c in _COMPARED)
)
def compared_orders(spark, sf_dir):
    """Orders that are added, removed or changed, cell by cell, between two versions; ranges of equal hash are not read."""
    o = table(spark, sf_dir, "orders")
    text = lambda c: F.expr(f"cast(cast({c} as decimal(18,2)) as string)")
    old = o.filter("o_orderkey % 97 <> 5").select("o_orderkey", "o_custkey", "o_orderstatus", text("o_totalprice").alias("price"), F.expr("nullif(o_orderpriority, '5-LOW') as priority"))
    new = o.filter("o_orderkey % 89 <> 11").select("o_orderkey", F.expr("if(o_orderkey % 41 = 3, o_custkey + 1, o_custkey) as o_custkey"), "o_orderstatus", text("if(o_orderkey % 53 = 9, o_totalprice + 1, o_totalprice)").alias("price"), F.expr("if(o_orderkey % 61 = 7, null, nullif(o_orderpriority, '5-LOW')) as priority"))
    return compare.compare(old, new, ["o_orderkey"])


# --- fuzzy reconciliation

_NAME = "lower(c_mktsegment) || ' ' || substr(md5('n' || c_custkey), 1, 10)"
_DAMAGED = "CASE c_custkey % 5 WHEN 0 THEN n WHEN 1 THEN substr(n, 1, 6) || substr(n, 8) WHEN 2 THEN substr(n, 1, 12) || 'zz' || substr(n, 15) WHEN 3 THEN 'x' || n ELSE substr(n, 1, length(n) - 2) END"


@register(
    f"""WITH l AS (SELECT c_custkey, {_NAME} AS n FROM customer), r AS (SELECT c_custkey + 1000000 AS k, {_DAMAGED} AS n FROM l WHERE c_custkey % 3 <> 0),
p AS (SELECT c_custkey AS left_key, k AS right_key, CAST(levenshtein(l.n, r.n) AS INT) AS distance FROM l JOIN r ON abs(length(l.n) - length(r.n)) <= 2 WHERE levenshtein(l.n, r.n) <= 2)
SELECT * FROM p"""
)
def matched_customers(spark, sf_dir):
    """Customers matched one to one with names of which each has up to two edits; all pairs within two edits are these."""
    left = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_NAME} as n")
    right = left.filter("c_custkey % 3 <> 0").selectExpr("c_custkey + 1000000 as k", f"{_DAMAGED} as n")
    return fuzzy.fuzzy_match(left, right, ("c_custkey", "k"), ("n", "n"))


# --- references and dependencies


@register(
    """WITH c AS (SELECT CASE WHEN o_orderkey % 19 = 0 THEN o_custkey + 100000 WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 777777 ELSE o_custkey END AS customer FROM orders)
SELECT customer, count(*) AS n FROM c WHERE customer IS NOT NULL AND customer NOT IN (SELECT c_custkey FROM customer) GROUP BY 1"""
)
def orphan_customers(spark, sf_dir):
    """Customers that orders name and that are not there, with the orders that name them; one has a third of all orders."""
    o = table(spark, sf_dir, "orders").selectExpr("case when o_orderkey % 19 = 0 then o_custkey + 100000 when o_orderkey % 23 = 0 then null when o_orderkey % 3 = 0 then 777777 else o_custkey end as customer")
    return integrity.orphans(o, table(spark, sf_dir, "customer"), ["customer"], ["c_custkey"])


_WIDE = "SELECT c_custkey, c_nationkey, n_name, n_regionkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE r_name END AS region, c_mktsegment, c_custkey % 7 AS seventh, (c_custkey % 7) * 10 + length(c_mktsegment) AS mixed FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_COLUMNS = ("c_custkey", "c_nationkey", "n_name", "n_regionkey", "region", "c_mktsegment", "seventh", "mixed")


def _dependency_sql() -> str:
    """Each determinant of one or two columns, checked by a grouping of its own; those that hold a smaller one are left out."""
    checks = []
    for size in (1, 2):
        for s in combinations(_COLUMNS, size):
            cells = ", ".join(f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS d_{c}" for c in _COLUMNS if c not in s)
            checks.append(f"SELECT {list(s)} AS det, unnest([{', '.join(repr(c) for c in _COLUMNS if c not in s)}, NULL]) AS dependent, unnest([{', '.join(f'max(d_{c})' for c in _COLUMNS if c not in s)}, max(n)]) AS worst FROM (SELECT count(*) AS n, {cells} FROM w GROUP BY {', '.join(s)})")
    return f"""WITH w AS ({_WIDE}), h AS (SELECT det, dependent FROM ({' UNION ALL '.join(checks)}) WHERE worst = 1)
SELECT array_to_string(det, ',') AS determinant, dependent FROM h WHERE NOT EXISTS (
  SELECT 1 FROM h k WHERE list_has_all(h.det, k.det) AND ((k.dependent IS NULL AND len(k.det) < len(h.det)) OR (k.dependent IS NULL AND h.dependent IS NOT NULL AND k.det = h.det)
    OR (k.dependent = h.dependent AND len(k.det) < len(h.det))))"""


@register(_dependency_sql())
def dependencies_of_customers(spark, sf_dir):
    """Minimal keys and functional dependencies of customers with their nations and regions, of up to two columns."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    wide = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    wide = wide.selectExpr("c_custkey", "c_nationkey", "n_name", "n_regionkey", "if(n_regionkey = 2, null, r_name) as region", "c_mktsegment", "c_custkey % 7 as seventh", "(c_custkey % 7) * 10 + length(c_mktsegment) as mixed")
    return integrity.dependencies(wide)


# --- nested records


def _folded_lines(spark, sf_dir):
    """Conversations as JSON lines, a record each with its turns in a list; some have a title and an object of numbers."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    meta = F.when(F.col("conv_id") % 3 == 0, F.struct((F.col("conv_id") * 2).alias("twice"), F.struct((F.col("conv_id") / 4).alias("quarter")).alias("deep")))
    rows = turns.select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("title \"q\" "), "conv_id")).alias("title"), meta.alias("meta"), "turns")
    path = fresh_path(spark, "json")
    rows.select("conv_id", F.to_json(F.struct("conv_id", "title", "meta", "turns")).alias("value")).write.parquet(path)
    return spark.read.parquet(path)


@register("SELECT conv_id, turn, role, text FROM conversations")
def nested_turns(spark, sf_dir):
    """The turns of conversations that were folded to JSON, from the table of their lists joined to that of the records."""
    found = nested.read_nested(spark, _folded_lines(spark, sf_dir), ["conv_id"])
    parents = found.tables[""].select(F.col("__row_id").alias("__parent_id"), "conv_id")
    return found.tables["turns"].join(parents, "__parent_id").select("conv_id", "turn", "role", "text")


@register(
    """SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'title "q" ' || conv_id END AS title, CASE WHEN conv_id % 3 = 0 THEN conv_id * 2 END AS twice, CASE WHEN conv_id % 3 = 0 THEN conv_id / 4 END AS quarter, count(*) AS turns FROM conversations GROUP BY conv_id"""
)
def nested_records(spark, sf_dir):
    """The records themselves, objects flattened to dotted columns, with the length of each list."""
    found = nested.read_nested(spark, _folded_lines(spark, sf_dir), ["conv_id"])
    sizes = found.tables["turns"].groupBy(F.col("__parent_id").alias("__row_id")).agg(F.count("*").alias("turns"))
    return found.tables[""].join(sizes, "__row_id").select("conv_id", "title", F.col("`meta.twice`").alias("twice"), F.col("`meta.deep.quarter`").cast("double").alias("quarter"), "turns")


# --- a folder of files


@register(
    """SELECT 'a_nation' AS folder, 'eligible' AS state, count(*) AS rows, 'n_nationkey integer, n_name text, n_regionkey integer' AS columns FROM nation
UNION ALL SELECT 'b_copy', 'duplicate', NULL, '' UNION ALL SELECT 'c_supplier', 'eligible', count(*), 's_suppkey integer, s_name text' FROM supplier UNION ALL SELECT 'd_blank', 'quarantined', NULL, ''
UNION ALL SELECT 'e_known', 'unchanged', NULL, ''"""
)
def batch_catalog(spark, sf_dir):
    """Files of a folder with state, chosen table's rows and types: two tables, a copy, a file without a table, a known one."""
    path = fresh_path(spark, "batch")
    put = lambda df, name: df.coalesce(1).write.option("header", True).csv(f"{path}/{name}")
    nation = written(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")
    put(nation, "a_nation")
    put(nation, "b_copy")
    # a total below the data is no data row
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("at"), F.concat_ws(",", "s_suppkey", "s_name").alias("line"))
    marks = spark.createDataFrame([(-1, "s_suppkey,s_name"), (10**12, "Grand total,")], "at long, line string")
    lines.union(marks).orderBy("at").select("line").coalesce(1).write.text(f"{path}/c_supplier")
    spark.createDataFrame([(" , ",), ("",)], "line string").coalesce(1).write.text(f"{path}/d_blank")
    put(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "e_known")
    config = files.FolderConfig(path, recursive=True, extensions=["csv", "txt"])
    scanned = written(files.scan_folder(spark, config), "scanned")
    known = scanned.filter(F.col("relative_path").startswith("e_known/"))
    found = files.build_catalog(spark, scanned, known)
    columns = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["column"], c["data_type"])), ", ")
    return found.select(F.element_at(F.split("relative_path", "/"), 1).alias("folder"), "state", "rows", columns.alias("columns"))
