"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepweave import catalog_ordered, catalog_quality, catalog_runs, catalog_sources, catalog_streams, catalog_summaries  # noqa: F401  these register their queries
from prepweave.errors import PlanError
from prepweave.functions import expressions as ex
from prepweave.functions.expressions import fld, fn, lit
from prepweave.operators import mapping, split, validation
from prepweave.operators.aggregate import AggregateConfig, Measure, aggregate_table
from prepweave.operators.append import AppendConfig, append_tables
from prepweave.operators.cleaning import Operation, apply_operation
from prepweave.operators.joins import JoinConfig, analyse, join_tables
from prepweave.operators.reshape import PivotConfig, UnpivotConfig, pivot_table, unpivot_table
from prepweave.plans.drift import Expected, Observed, analyse_drift
from prepweave.plans.evidence import write_split
from prepweave.plans.workflow import WorkflowPlan, compile_workflow, reconcile
from prepweave.registry import add, oracle_sql, queries, register, table  # noqa: F401
from prepweave.sources import discovery
from prepweave.sources.grid import read_source
from prepweave.tables import fresh_path

FLAGSHIP = "customer_segment_report"
TODAY = dt.date(2026, 7, 17)


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def doubled(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines' results have one type."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if k.startswith("decimal") else F.col(f"`{c}`") for c, k in df.dtypes])


# --- aggregation and the stages after it


@register(
    """WITH g AS (SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS orders,
  count(DISTINCT o_custkey) AS customers, median(CAST(o_totalprice AS DOUBLE)) AS middle,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS exact
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_mktsegment, revenue, orders, customers, middle, orders / CAST(sum(orders) OVER () AS DOUBLE) * 100 AS orders_percentage_of_total,
  dense_rank() OVER (ORDER BY revenue DESC) AS rank, CAST(sum(exact) OVER (ORDER BY revenue DESC, c_mktsegment ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM g"""
)
def customer_segment_report(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = join_tables(orders, customer, JoinConfig("inner", ["o_custkey"], ["c_custkey"], unique_side="right")).table
    config = AggregateConfig(
        ["c_mktsegment"],
        [Measure("price", "sum", "revenue"), Measure("o_orderkey", "count", "orders"), Measure("o_custkey", "unique_count", "customers"), Measure("price", "median", "middle")],
        sort_fields=["revenue"], descending=True, percentage_of_total_fields=["orders"], rank_field="revenue", running_total_field="revenue",
    )
    return doubled(aggregate_table(joined.withColumn("price", money("o_totalprice")), config))


@register(
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(l_tax) AS n, count(DISTINCT l_suppkey) AS suppliers,
  CAST(min(l_extendedprice) AS DOUBLE) AS lowest, CAST(max(l_extendedprice) AS DOUBLE) AS highest, median(l_discount) AS middle FROM lineitem GROUP BY 1, 2"""
)
def aggregate_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("q", money("l_quantity"))
    measures = [Measure("q", "sum", "quantity"), Measure("l_tax", "count", "n"), Measure("l_suppkey", "unique_count", "suppliers"), Measure("l_extendedprice", "minimum", "lowest"), Measure("l_extendedprice", "maximum", "highest"), Measure("l_discount", "median", "middle")]
    return doubled(aggregate_table(df, AggregateConfig(["l_returnflag", "l_linestatus"], measures)))


@register(
    """WITH e AS (SELECT *, NULLIF(user_id % 7, 0) AS k FROM events)
SELECT event_type, count(k) AS n, count(DISTINCT k) + max(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS kinds, CAST(COALESCE(sum(k), 0) AS BIGINT) AS total, avg(COALESCE(k, 0)) AS mean_zero FROM e GROUP BY 1"""
)
def aggregate_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("k", F.expr("nullif(user_id % 7, 0)"))
    measures = [Measure("k", "count", "n"), Measure("k", "unique_count", "kinds"), Measure("k", "sum", "total"), Measure("k", "average", "mean_zero", "zero")]
    return aggregate_table(df, AggregateConfig(["event_type"], measures))


@register(
    """SELECT event_type, min(CASE WHEN event_id = lo THEN user_id END) AS first_user, min(CASE WHEN event_id = hi THEN user_id END) AS last_user
FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type) AS lo, max(event_id) OVER (PARTITION BY event_type) AS hi FROM events) GROUP BY 1"""
)
def aggregate_first_last(spark, sf_dir):
    measures = [Measure("user_id", "first", "first_user"), Measure("user_id", "last", "last_user")]
    return aggregate_table(table(spark, sf_dir, "events"), AggregateConfig(["event_type"], measures), order=["event_id"])


@register("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, o_custkey LIMIT 10")
def aggregate_top_n(spark, sf_dir):
    config = AggregateConfig(["o_custkey"], [Measure("o_orderkey", "count", "n")], sort_fields=["n"], descending=True, top_n=10)
    return aggregate_table(table(spark, sf_dir, "orders"), config)


# --- append and duplicate policies: orders, and again those with status F


def _halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return [o, o.filter("o_orderstatus = 'F'").withColumn("extra", F.lit(1)).drop("o_totalprice")]


UNION = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(NULL AS INTEGER) AS extra, 0 AS place FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, NULL, 1, 1 FROM orders WHERE o_orderstatus = 'F'"
PLAIN = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, extra"


def _append(policy, keys, part="table"):
    return lambda spark, sf_dir: getattr(append_tables(_halves(spark, sf_dir), AppendConfig(duplicate_policy=policy, duplicate_key_fields=keys), ["o_orderkey"]), part)


add("append_keep_all", _append("keep_all", []), f"SELECT {PLAIN} FROM ({UNION})")
add("union_bag", lambda s, d: append_tables([table(s, d, "customer").select("c_nationkey"), table(s, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))]).table, "SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_ranked = "SELECT {p} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY place {w}) AS rn FROM ({u})) WHERE rn = 1"
add("append_keep_first", _append("keep_first", ["o_orderkey"]), _ranked.format(p=PLAIN, w="", u=UNION))
add("append_keep_last", _append("keep_last", ["o_orderkey"]), _ranked.format(p=PLAIN, w="DESC", u=UNION))
_counted = "SELECT {p}{c} FROM (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n FROM ({u})) WHERE n {w}"
add("append_reject_kept", _append("reject", ["o_orderkey"]), _counted.format(p=PLAIN, c="", w="= 1", u=UNION))
add("append_rejected", _append("reject", ["o_orderkey"], "rejected"), _counted.format(p=PLAIN, c=", 'DUPLICATE_ROW_REJECTED' AS __reason_codes", w="> 1", u=UNION))
add("append_review", _append("route_review", ["o_orderkey"], "review"), _counted.format(p=PLAIN, c=", 'DUPLICATE_ROW_REVIEW' AS __reason_codes", w="> 1", u=UNION))
add(
    "append_remove_exact",
    lambda s, d: append_tables([table(s, d, "customer").select("c_nationkey", "c_mktsegment")] * 2, AppendConfig(duplicate_policy="remove_exact")).table,
    "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
)
add("append_duplicate_rows", _append("reject", ["o_orderkey"], "duplicates"), f"SELECT CAST(count(*) AS BIGINT) AS duplicate_rows FROM (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n FROM ({UNION})) WHERE n > 1")

# --- joins: customers of some nations, nations with a null key and one that no customer has


def _sides(spark, sf_dir):
    """All customers and nations; some keys are null or changed, so that both sides have rows without a partner."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("nationkey"))
    n = table(spark, sf_dir, "nation").select(F.expr("if(n_nationkey % 5 = 4, n_nationkey + 1000, nullif(n_nationkey, 7))").alias("nationkey"), "n_name")
    return c, n


SIDES = "WITH c AS (SELECT c_custkey, NULLIF(c_nationkey, 3) AS nationkey FROM customer), n AS (SELECT CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey + 1000 ELSE NULLIF(n_nationkey, 7) END AS nationkey, n_name FROM nation) "


def _join(kind, part="table", **more):
    return lambda spark, sf_dir: getattr(join_tables(*_sides(spark, sf_dir), JoinConfig(kind, ["nationkey"], ["nationkey"], **more)), part)


_cols = "c.c_custkey, c.nationkey, n.nationkey AS nationkey_right, n.n_name"
for _kind in ("inner", "left", "right", "full"):
    add(f"join_{_kind}", _join(_kind), f"{SIDES} SELECT {_cols} FROM c {_kind.upper()} JOIN n ON c.nationkey = n.nationkey")
add("join_semi", _join("semi"), f"{SIDES} SELECT * FROM c WHERE EXISTS (SELECT 1 FROM n WHERE n.nationkey = c.nationkey)")
add("join_anti", _join("anti"), f"{SIDES} SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.nationkey = c.nationkey)")
add("join_match_nulls", _join("inner", null_key_policy="match_nulls"), f"{SIDES} SELECT {_cols} FROM c JOIN n ON c.nationkey IS NOT DISTINCT FROM n.nationkey")
add("join_left_unmatched", _join("inner", "left_unmatched"), f"{SIDES} SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.nationkey = c.nationkey)")
add("join_right_unmatched", _join("inner", "right_unmatched"), f"{SIDES} SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE n.nationkey = c.nationkey)")
add("join_output_fields", _join("left", output_fields=["n_name", "c_custkey"]), f"{SIDES} SELECT n_name, c_custkey FROM c LEFT JOIN n ON c.nationkey = n.nationkey")


def _users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'click'").select("event_id", "user_id"), e.filter("event_type = 'purchase'").select("event_id", "user_id")


add(
    "join_many_to_many",
    lambda s, d: join_tables(*_users(s, d), JoinConfig("inner", ["user_id"], ["user_id"], approve_many_to_many=True)).table,
    "SELECT a.event_id, a.user_id, b.event_id AS event_id_right, b.user_id AS user_id_right FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
)
add(
    "join_keep_first",
    lambda s, d: join_tables(*_users(s, d), JoinConfig("inner", ["user_id"], ["user_id"], duplicate_key_policy="keep_first"), (["event_id"], ["event_id"])).table,
    "WITH a AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT a.event_id, a.user_id, b.event_id AS event_id_right, b.user_id AS user_id_right FROM a JOIN b USING (user_id)",
)
add(
    "join_keep_last",
    lambda s, d: join_tables(*_users(s, d), JoinConfig("inner", ["user_id"], ["user_id"], duplicate_key_policy="keep_last"), (["event_id"], ["event_id"])).table,
    "WITH a AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT a.event_id, a.user_id, b.event_id AS event_id_right, b.user_id AS user_id_right FROM a JOIN b USING (user_id)",
)
add(
    "join_review",
    lambda s, d: join_tables(*_users(s, d), JoinConfig("inner", ["user_id"], ["user_id"], duplicate_key_policy="review")).review,
    """SELECT event_id, user_id, 'left' AS __join_side, 'DUPLICATE_JOIN_KEY' AS __reason_codes FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'click') WHERE n > 1
UNION ALL SELECT event_id, user_id, 'right', 'DUPLICATE_JOIN_KEY' FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase') WHERE n > 1""",
)
add(
    "join_normalised_keys",
    lambda s, d: join_tables(
        table(s, d, "nation").select("n_nationkey", F.concat(F.lit("  "), F.lower("n_name")).alias("k")), table(s, d, "nation").select("n_regionkey", F.col("n_name").alias("k")),
        JoinConfig("inner", ["k"], ["k"], key_normalisation=["trim", "uppercase"]),
    ).table,
    "SELECT a.n_nationkey, '  ' || lower(a.n_name) AS k, b.n_regionkey, b.n_name AS k_right FROM nation a JOIN nation b ON upper(trim(a.n_name)) = upper(trim(b.n_name))",
)
add(
    "join_diagnostics",
    lambda s, d: analyse(*_sides(s, d), JoinConfig("full", ["nationkey"], ["nationkey"])).select("cardinality", "left_rows", "right_rows", "null_left_keys", "null_right_keys", "left_unmatched", "right_unmatched", "estimated_rows"),
    f"""{SIDES} SELECT 'many_to_one' AS cardinality, (SELECT count(*) FROM c) AS left_rows, (SELECT count(*) FROM n) AS right_rows, (SELECT count(*) FROM c WHERE nationkey IS NULL) AS null_left_keys,
(SELECT count(*) FROM n WHERE nationkey IS NULL) AS null_right_keys, (SELECT count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.nationkey = c.nationkey)) AS left_unmatched,
(SELECT count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE n.nationkey = c.nationkey)) AS right_unmatched, (SELECT count(*) FROM c FULL JOIN n ON c.nationkey = n.nationkey) AS estimated_rows""",
)

# --- reshape

_status = ("F", "O", "P")
_cells = ", ".join(f"CAST(COALESCE(sum(CASE WHEN o_orderstatus = '{x}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS \"{x}\"" for x in _status)
add("pivot_sum", lambda s, d: doubled(pivot_table(table(s, d, "orders").withColumn("p", money("o_totalprice")), PivotConfig(["o_orderpriority"], ["o_orderstatus"], "p"))), f"SELECT o_orderpriority, {_cells} FROM orders GROUP BY 1")
_counts = ", ".join(f"count(CASE WHEN o_orderstatus = '{x}' THEN 1 END) AS \"{x}\"" for x in _status)
add("pivot_count", lambda s, d: pivot_table(table(s, d, "orders"), PivotConfig(["o_custkey"], ["o_orderstatus"], "o_orderkey", "count")), f"SELECT o_custkey, {_counts} FROM orders GROUP BY 1")
_fill = ", ".join(f"COALESCE(max(CASE WHEN o_orderstatus = '{x}' THEN o_orderkey END), -1) AS \"{x}\"" for x in _status)
add("pivot_fill", lambda s, d: pivot_table(table(s, d, "orders"), PivotConfig(["o_custkey"], ["o_orderstatus"], "o_orderkey", "maximum", fill_value=-1)), f"SELECT o_custkey, {_fill} FROM orders GROUP BY 1")
_two = ", ".join(f"count(CASE WHEN l_returnflag = '{a}' AND l_linestatus = '{b}' THEN 1 END) AS \"{a}__{b}\"" for a in "ANR" for b in "FO")
add("pivot_two_keys", lambda s, d: pivot_table(table(s, d, "lineitem"), PivotConfig(["l_linenumber"], ["l_returnflag", "l_linestatus"], "l_orderkey", "count")), f"SELECT l_linenumber, {_two} FROM lineitem GROUP BY 1")
_vars = ("l_quantity", "l_discount", "l_tax")
add(
    "unpivot_drop",
    lambda s, d: unpivot_table(table(s, d, "lineitem").withColumn("l_tax", F.expr("nullif(l_tax, 0)")), UnpivotConfig(["l_orderkey", "l_linenumber"], list(_vars))),
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{v}' AS variable, {'NULLIF(l_tax, 0)' if v == 'l_tax' else v} AS value FROM lineitem" for v in _vars) + ") WHERE value IS NOT NULL",
)
add(
    "unpivot_keep_mixed",
    lambda s, d: unpivot_table(table(s, d, "part"), UnpivotConfig(["p_partkey"], ["p_brand", "p_size"], null_row_handling="keep")),
    "SELECT p_partkey, 'p_brand' AS variable, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part",
)

# --- split

add(
    "split_chunks",
    lambda s, d: split.split_table(table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus"), split.SplitConfig(["day", "o_orderstatus"], "quarter", 100), ["o_orderkey"]).drop("__split_group"),
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) || '__' || o_orderstatus AS k FROM orders)
SELECT o_orderkey, day, o_orderstatus, k AS __split_key, CAST(ceil(row_number() OVER (PARTITION BY k ORDER BY o_orderkey) / 100.0) AS BIGINT) AS __chunk FROM o""",
)
add(
    "split_condition",
    lambda s, d: split.split_table(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), split.SplitConfig(["c_nationkey"], condition=fn("greater_than", fld("c_custkey"), lit(100, "integer")), minimum_group_size=5), ["c_custkey"]).drop("__split_group"),
    """WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey > 100), n AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM c)
SELECT c_custkey, c_mktsegment, c_nationkey, CAST(c_nationkey AS VARCHAR) AS __split_key, CAST(1 AS BIGINT) AS __chunk FROM n WHERE n >= 5""",
)

# --- cleaning operations


def _op(name, column="c_name", **config):
    raw = lambda: F.concat(F.lit(" \t"), F.regexp_replace("c_name", "#", "  o'"), F.lit(" "))
    return lambda s, d: apply_operation(table(s, d, "customer").select("c_custkey", raw().alias("c_name")), Operation(name, {"field_id": "c_name", **config}))


_raw = "' ' || chr(9) || replace(c_name, '#', '  o''') || chr(160)"
_strip = "regexp_replace(regexp_replace({x}, '^[\\s ]+', ''), '[\\s ]+$', '')"
add("op_trim", _op("text.trim"), f"SELECT c_custkey, {_strip.format(x=_raw)} AS c_name FROM customer")
add("op_normalise_spaces", _op("text.normalise_spaces"), f"SELECT c_custkey, {_strip.format(x=f'''regexp_replace({_raw}, '[\\s ]+', ' ', 'g')''')} AS c_name FROM customer")
add("op_uppercase", lambda s, d: apply_operation(table(s, d, "documents").select("doc_id", "text"), Operation("text.uppercase", {"field_id": "text"})), "SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS text FROM documents")
add("op_lowercase", lambda s, d: apply_operation(table(s, d, "part").select("p_partkey", "p_name"), Operation("text.lowercase", {"field_id": "p_name"})), "SELECT p_partkey, lower(p_name) AS p_name FROM part")
add(
    "op_proper_case",
    lambda s, d: apply_operation(table(s, d, "part").select("p_partkey", "p_type"), Operation("text.proper_case", {"field_id": "p_type"})),
    "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_type, '([A-Za-z]+|[^A-Za-z]+)'), lambda w: upper(w[1]) || lower(w[2:])), '') AS p_type FROM part",
)
add("op_remove_non_printable", _op("text.remove_non_printable"), f"SELECT c_custkey, {_raw} AS c_name FROM customer")
add(
    "op_normalise_nulls",
    lambda s, d: apply_operation(table(s, d, "orders").select("o_orderkey", F.expr("case when o_orderstatus = 'P' then ' N/A ' else o_orderstatus end").alias("st")), Operation("text.normalise_nulls", {"field_id": "st"})),
    "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS st FROM orders",
)
add("op_rename_select_reorder", lambda s, d: apply_operation(apply_operation(apply_operation(table(s, d, "nation"), Operation("field.rename", {"field_id": "n_name", "new_field_id": "nation"})), Operation("field.select", {"field_ids": ["n_nationkey", "nation"]})), Operation("field.reorder", {"field_ids": ["nation"]})), "SELECT n_name AS nation, n_nationkey FROM nation")
add(
    "op_remove_blank",
    lambda s, d: apply_operation(table(s, d, "orders").select(F.expr("nullif(o_orderstatus, 'F')").alias("a"), F.expr("case when o_orderpriority like '1%' then '' else o_orderpriority end").alias("b")), Operation("row.remove_blank", {"field_ids": ["a", "b"]})),
    "SELECT * FROM (SELECT NULLIF(o_orderstatus, 'F') AS a, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END AS b FROM orders) WHERE a IS NOT NULL OR b <> ''",
)
add(
    "op_remove_repeated_headers",
    lambda s, d: apply_operation(table(s, d, "nation").select("n_nationkey", F.expr("nullif(n_name, 'CHINA')").alias("n_name")), Operation("row.remove_repeated_headers", {"header_values": {"n_name": "brazil"}})),
    "SELECT n_nationkey, NULLIF(n_name, 'CHINA') AS n_name FROM nation WHERE upper(n_name) IS DISTINCT FROM 'BRAZIL'",
)
add(
    "op_group_aggregate",
    lambda s, d: apply_operation(table(s, d, "supplier").select(F.col("s_nationkey"), F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(F.col("s_suppkey").cast("string")).alias("v")), Operation("group.aggregate", {"group_by": ["s_nationkey"], "aggregates": [{"field_id": "v", "function": f, "output_field_id": f} for f in ("sum", "minimum", "maximum", "mean", "count")]})).withColumnsRenamed({"sum": "a_sum", "minimum": "a_min", "maximum": "a_max", "mean": "a_mean", "count": "a_count"}),
    "WITH v AS (SELECT s_nationkey, TRY_CAST(CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE CAST(s_suppkey AS VARCHAR) END AS DOUBLE) AS v FROM supplier) SELECT s_nationkey, COALESCE(sum(v), 0) AS a_sum, min(v) AS a_min, max(v) AS a_max, avg(v) AS a_mean, count(*) AS a_count FROM v GROUP BY 1",
)

# --- expressions: one query per function, over orders, customers and parts

_o = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_orderpriority": "text", "o_totalprice": "decimal", "o_orderdate": "datetime", "day": "date", "st": "text"}


def _value(node, fields=("o_orderkey",)):
    def run(spark, sf_dir):
        o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("st", F.expr("nullif(o_orderstatus, 'P')"))
        out, (done,) = ex.evaluated(o, [node], _o, TODAY)
        return doubled(out.select("o_orderkey", done.value.alias("v")))

    return run


_k, _c, _st, _pr = fld("o_orderkey"), fld("o_custkey"), fld("st"), fld("o_orderpriority")
_flag = fn("equal", fn("extract_month", fld("day")), lit(1, "integer"))
_d = "CAST(o_orderdate AS DATE)"
_S = "NULLIF(o_orderstatus, 'P')"
# calls in calls to the deepest level that is allowed
_nested, _nested_sql = _k, "o_orderkey"
for _i in range(31):
    _nested = (fn("add", _nested, _c), fn("subtract", _nested, lit(700, "integer")), fn("absolute", _nested))[_i % 3]
    _nested_sql = (f"({_nested_sql} + o_custkey)", f"({_nested_sql} - 700)", f"abs({_nested_sql})")[_i % 3]
EXPRESSIONS = {
    "add": (fn("add", _k, _c), "o_orderkey + o_custkey"),
    "subtract": (fn("subtract", _k, _c), "o_orderkey - o_custkey"),
    "multiply": (fn("multiply", _k, _c), "o_orderkey * o_custkey"),
    "divide": (fn("divide", fn("multiply", _k, lit(3, "integer")), lit(4, "integer")), "o_orderkey * 3 / 4.0::DOUBLE"),
    "percentage": (fn("percentage", _k, lit(8, "integer")), "o_orderkey * 12.5::DOUBLE"),
    "absolute": (fn("absolute", fn("subtract", _c, _k)), "abs(o_custkey - o_orderkey)"),
    "round": (fn("round", fn("divide", _k, lit(8, "integer")), lit(1, "integer")), "CAST(round(CAST(o_orderkey / 8.0 AS DECIMAL(18,6)), 1) AS DOUBLE)"),
    "nested": (_nested, _nested_sql),
    "minimum": (fn("minimum", _k, _c), "least(o_orderkey, o_custkey)"),
    "maximum": (fn("maximum", _k, _c), "greatest(o_orderkey, o_custkey)"),
    "concatenate": (fn("concatenate", _st, lit("-", "text"), _k, fn("equal", _k, _c)), f"CASE WHEN {_S} IS NOT NULL THEN o_orderstatus || '-' || o_orderkey || CASE WHEN o_orderkey = o_custkey THEN 'True' ELSE 'False' END END"),
    "length": (fn("length", _pr), "CAST(length(o_orderpriority) AS BIGINT)"),
    "substring": (fn("substring", _pr, lit(2, "integer"), lit(4, "integer")), "substr(o_orderpriority, 3, 4)"),
    "starts_with": (fn("starts_with", _pr, lit("1", "text")), "starts_with(o_orderpriority, '1')"),
    "ends_with": (fn("ends_with", _pr, lit("T", "text")), "ends_with(o_orderpriority, 'T')"),
    "contains": (fn("contains", _pr, lit("IG", "text")), "contains(o_orderpriority, 'IG')"),
    "replace": (fn("replace", _pr, lit("-", "text"), lit("_", "text")), "replace(o_orderpriority, '-', '_')"),
    "coalesce": (fn("coalesce", _st, lit("none", "text")), f"coalesce({_S}, 'none')"),
    "if": (fn("if", fn("equal", _st, lit("F", "text")), _k, _c), f"CASE WHEN {_S} = 'F' THEN o_orderkey ELSE o_custkey END"),
    "and": (fn("and", _flag, fn("equal", _st, lit("F", "text"))), f"CASE WHEN {_S} IS NOT NULL THEN month(o_orderdate) = 1 AND o_orderstatus = 'F' END"),
    "or": (fn("or", _flag, fn("equal", _st, lit("F", "text"))), f"CASE WHEN {_S} IS NOT NULL THEN month(o_orderdate) = 1 OR o_orderstatus = 'F' END"),
    "not": (fn("not", fn("equal", _st, lit("F", "text"))), f"NOT ({_S} = 'F')"),
    "equal": (fn("equal", _st, lit("F", "text")), f"{_S} = 'F'"),
    "not_equal": (fn("not_equal", _st, lit("F", "text")), f"{_S} <> 'F'"),
    "greater_than": (fn("greater_than", _k, _c), "o_orderkey > o_custkey"),
    "less_than": (fn("less_than", _k, _c), "o_orderkey < o_custkey"),
    "is_null": (fn("is_null", _st), f"{_S} IS NULL"),
    "is_not_null": (fn("is_not_null", _st), f"{_S} IS NOT NULL"),
    "in": (fn("in", _st, lit("F", "text"), lit("O", "text")), f"{_S} IN ('F', 'O')"),
    "date_difference": (fn("date_difference", fn("today"), fld("day")), f"CAST(date_diff('day', {_d}, DATE '2026-07-17') AS BIGINT)"),
    "add_days": (fn("add_days", fld("day"), lit(30, "integer")), f"CAST({_d} + INTERVAL 30 DAY AS DATE)"),
    "extract_year": (fn("extract_year", fld("day")), f"CAST(year({_d}) AS BIGINT)"),
    "extract_month": (fn("extract_month", fld("day")), f"CAST(month({_d}) AS BIGINT)"),
    "extract_day": (fn("extract_day", fld("day")), f"CAST(day({_d}) AS BIGINT)"),
    "today": (fn("today"), "DATE '2026-07-17'"),
}
for _name, (_node, _sql) in EXPRESSIONS.items():
    add(f"fn_{_name}", _value(_node), f"SELECT o_orderkey, {_sql} AS v FROM orders")


@register(
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN CAST(CAST(o_orderkey AS DECIMAL(18,6)) / (o_custkey % 3) AS DOUBLE) END AS ratio, CASE WHEN o_custkey % 3 = 0 THEN 'RATIO_FAILED' ELSE '' END AS reasons FROM orders"""
)
def calculation_reject_row(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey % 3").alias("d"))
    config = ex.Calculation("ratio", "ratio", "decimal", fn("divide", fld("o_orderkey"), fld("d")), reason_code="RATIO_FAILED")
    out = ex.apply_calculation(o, config, {"o_orderkey": "integer", "d": "integer"}, TODAY)
    return doubled(out.select("o_orderkey", "ratio", F.array_join(ex.REASONS, ",").alias("reasons")))


# --- validation

_defects = ["c_custkey as __row_id", "case when c_custkey % 11 = 0 then '  ' else c_name end as name", "case when c_custkey % 7 = 0 then 'bad' else cast(c_custkey as string) end as number", "c_mktsegment as segment", "cast(c_nationkey as string) as nation"]
RULES = {
    "required": (validation.Rule("r", "required", "name", "NAME_MISSING"), "c_custkey % 11 = 0", "CASE WHEN c_custkey % 11 = 0 THEN '  ' END"),
    "data_type": (validation.Rule("r", "data_type", "number", "NOT_INTEGER", config={"data_type": "integer"}), "c_custkey % 7 = 0", "'bad'"),
    "unique": (validation.Rule("r", "unique", "nation", "NATION_REPEATED"), "n > 1", "CAST(c_nationkey AS VARCHAR)"),
    "allowed_values": (validation.Rule("r", "allowed_values", "segment", "SEGMENT", config={"values": ["BUILDING", "MACHINERY"]}), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "c_mktsegment"),
    "min_max": (validation.Rule("r", "min_max", "number", "RANGE", config={"min": 100, "max": 500}), "c_custkey % 7 = 0 OR c_custkey NOT BETWEEN 100 AND 500", "CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE CAST(c_custkey AS VARCHAR) END"),
    "text_length": (validation.Rule("r", "text_length", "segment", "LENGTH", config={"min": 9, "max": 9}), "length(c_mktsegment) <> 9", "c_mktsegment"),
    "regex": (validation.Rule("r", "regex", "segment", "PATTERN", config={"pattern": "[A-F].*|H.+D"}), "NOT regexp_full_match(c_mktsegment, '[A-F].*|H.+D')", "c_mktsegment"),
}


def _rule(rule):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "customer").selectExpr(*_defects)
        return validation.findings(validation.annotate(df, [rule])).select("row_id", "reason_code", "original_value")

    return run


for _name, (_r, _where, _shown) in RULES.items():
    add(f"rule_{_name}", _rule(_r), f"SELECT c_custkey AS row_id, '{_r.reason_code}' AS reason_code, {_shown} AS original_value FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE {_where}")

# --- mapping and alignment


@register("SELECT s_suppkey AS __row_id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation, 'EUR' AS currency, CASE WHEN s_suppkey % 2 = 0 THEN 'none' ELSE s_name END AS note FROM supplier")
def map_supplier(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("note", F.expr("case when s_suppkey % 2 = 0 then '' else s_name end"))
    s = s.select(F.col("s_suppkey").alias("__row_id"), F.col("s_name").alias("Supplier Name"), F.col("s_nationkey").alias("Nation No"), "note")
    fields = (mapping.Field("name", "Supplier Name"), mapping.Field("nation", aliases=("Nation No",)), mapping.Field("currency"), mapping.Field("note"))
    maps = (mapping.Mapping("name", "Supplier Name"), mapping.Mapping("nation", "gone"), mapping.Mapping("currency", constant_value="EUR"), mapping.Mapping("note", "note", default_value="none"))
    return mapping.apply_mapping(s, mapping.MappingSet(fields, maps))


@register(
    """SELECT o_orderkey AS key, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS BIGINT) END AS customer, o_orderstatus = 'F' AS done, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS VARCHAR) AS note,
  o_orderkey AS __source_row, 'orders' AS __source_id, 'orders.parquet' AS __source_file, 't1' AS __source_table FROM orders"""
)
def align_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("__row_id"), "o_orderkey", F.expr("case when o_custkey % 5 = 0 then 'x' else cast(o_custkey as string) end").alias("cust"), F.expr("case when o_orderstatus = 'F' then 'yes' else 'no' end").alias("done"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    fields = (mapping.Field("key", data_type="integer"), mapping.Field("customer", data_type="integer"), mapping.Field("done", data_type="boolean"), mapping.Field("day", data_type="date"), mapping.Field("note"))
    maps = tuple(mapping.Mapping(t, c) for t, c in (("key", "o_orderkey"), ("customer", "cust"), ("done", "done"), ("day", "day")))
    source = mapping.AlignedSource("orders", mapping.MappingSet(fields, maps), "t1")
    return mapping.align_table(o, source, "orders.parquet", mapping.AlignmentPlan(fields, (source,)))


@register("SELECT row_number() OVER (ORDER BY event_id) AS __row_id, event_id FROM events")
def stable_row_ids(spark, sf_dir):
    return mapping.with_row_ids(table(spark, sf_dir, "events").select("event_id"), ["event_id"]).select("__row_id", "event_id")


# --- sources and discovery: the tables as delimited files


def _file(spark: SparkSession, df: DataFrame, name: str) -> str:
    """The rows as delimited files with a header, in order, below spark.checkpoint.dir."""
    path = fresh_path(spark, name)
    df.coalesce(1).write.option("header", True).csv(path)
    return path


@register("SELECT row_number() OVER (ORDER BY n_nationkey) + 1 AS __rn, CAST(n_nationkey AS VARCHAR) AS _c0, n_name AS _c1, CAST(n_regionkey AS VARCHAR) AS _c2 FROM nation UNION ALL SELECT 1, 'n_nationkey', 'n_name', 'n_regionkey'")
def source_delimited(spark, sf_dir):
    """A delimited file as a grid: all cells as text, rows numbered in file order."""
    return read_source(spark, _file(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"), "nation") + "/*.csv")


@register("SELECT row_number() OVER (ORDER BY s_suppkey) AS __row_id, CAST(s_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def discovered_table(spark, sf_dir):
    """The table that discovery finds in a file: its header names the columns, rows below it are data."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"), F.col("s_nationkey").alias("nation")).orderBy("supplier_id")
    grid = read_source(spark, _file(spark, rows, "supplier") + "/*.csv").persist()
    return discovery.read_table(grid, discovery.choose(discovery.discover(grid)))


def _profiled(c: str, kind: str, where: str = "") -> str:
    v = f"nullif(trim(CAST({c} AS VARCHAR)), '')"
    return f"SELECT '{c}' AS \"column\", '{kind}' AS data_type, count(*) AS rows, CAST(count(*) FILTER ({v} IS NULL) AS DOUBLE) / count(*) * 100 AS null_percentage, count(DISTINCT {v}) AS unique_count, count({v}) - count(DISTINCT {v}) AS duplicate_count, count({v}) = count(DISTINCT {v}) AS key_candidate FROM c"


@register(
    "WITH c AS (SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment, '0' || c_nationkey AS padded FROM customer) "
    + " UNION ALL ".join(_profiled(c, k) for c, k in (("c_custkey", "integer"), ("c_name", "text"), ("segment", "text"), ("padded", "text")))
)
def profile_columns(spark, sf_dir):
    """Types, nulls and different values of columns; numbers with a leading zero are text."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "case when c_custkey % 5 = 0 then '' else c_mktsegment end as segment", "concat('0', c_nationkey) as padded")
    return discovery.profile(c).select("column", "data_type", "rows", "null_percentage", "unique_count", "duplicate_count", "key_candidate")


@register(
    """SELECT o_orderkey AS __row_id, CASE o_orderkey % 8 WHEN 0 THEN 'repeated_header' WHEN 1 THEN 'grand_total' WHEN 2 THEN 'subtotal' WHEN 3 THEN 'generated_footer' WHEN 4 THEN 'signature' WHEN 5 THEN 'note' ELSE 'data' END AS kind FROM orders"""
)
def classified_rows(spark, sf_dir):
    """Rows of a table by kind: headers that come again, totals, footers, signatures, notes, data."""
    marks = "array('Status', 'Grand Total', 'Sub total of F', 'printed by the clerk', 'approved by the clerk', 'Note: late', 'noted', 'total')"
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as __row_id", f"{marks}[cast(o_orderkey % 8 as int)] as status", "case when o_orderkey % 8 = 0 then 'Key' else cast(o_custkey as string) end as key")
    return discovery.classify(o, ("Status", "Key")).select("__row_id", F.col("__row_class").alias("kind"))


@register(
    """WITH f AS (SELECT o_orderkey, o_totalprice FROM orders), a AS (SELECT 'orders' AS source_id, count(*) AS n, count(o_orderkey) AS keys, count(o_totalprice) AS prices FROM f),
b AS (SELECT 'lines' AS source_id, count(*) AS n, count(l_orderkey) AS keys, 0 AS prices FROM lineitem),
s AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT source_id, 'key' AS field_id, 'mapped' AS status, n AS rows, keys AS filled FROM s
UNION ALL SELECT source_id, 'price', CASE source_id WHEN 'orders' THEN 'mapped' ELSE 'missing_optional' END, n, prices FROM s
UNION ALL SELECT source_id, 'note', 'defaulted', n, n FROM s"""
)
def alignment_cells(spark, sf_dir):
    """What each source has for each canonical field, by the types its table has, and how many of its rows fill it."""
    fields = (mapping.Field("key", data_type="integer", required=True), mapping.Field("price", data_type="decimal"), mapping.Field("note"))
    maps = lambda key, price: mapping.MappingSet(fields, (mapping.Mapping("key", key), mapping.Mapping("price", price), mapping.Mapping("note", default_value="-")))
    tables = {"orders": table(spark, sf_dir, "orders"), "lines": table(spark, sf_dir, "lineitem")}
    sources = (mapping.AlignedSource("orders", maps("o_orderkey", "o_totalprice"), "t"), mapping.AlignedSource("lines", maps("l_orderkey", "gone"), "t"))
    plan = mapping.AlignmentPlan(fields, sources)
    cells = mapping.alignment_matrix({n: split.canonical_types(df) for n, df in tables.items()}, plan)
    status = spark.createDataFrame([(c["source_id"], c["field_id"], c["status"]) for c in cells], "source_id string, field_id string, status string")
    found = []
    for s in sources:
        df = mapping.align_table(tables[s.source_id].withColumn("__row_id", F.lit(0).cast("long")), s, s.source_id, plan)
        filled = F.array(*[F.struct(F.lit(f.id).alias("field_id"), F.count(f.id).alias("filled")) for f in fields])
        found.append(df.agg(F.count("*").alias("rows"), filled.alias("x")).select(F.lit(s.source_id).alias("source_id"), "rows", F.inline("x")))
    return status.join(found[0].unionByName(found[1]), ["source_id", "field_id"])


@register("SELECT * FROM (VALUES ('column_renamed', 'customer', false), ('data_type_changed', 'total', true), ('column_added', NULL, false)) t(category, field_id, blocking)")
def drift_findings(spark, sf_dir):
    """How the columns of orders, as a changed file has them, differ from a saved mapping."""
    fields = (mapping.Field("key", "o_orderkey", "integer", True), mapping.Field("customer", "Customer", "integer", aliases=("o_custkey",)), mapping.Field("total", "o_totalprice", "decimal", True))
    maps = mapping.MappingSet(fields, (mapping.Mapping("key", "o_orderkey"), mapping.Mapping("customer", "cust"), mapping.Mapping("total", "o_totalprice")))
    changed = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "concat(o_totalprice, ' EUR') as o_totalprice", "o_orderpriority as zzz")
    kinds = {r["column"]: r["data_type"] for r in discovery.profile(changed).collect()}  # a row a column
    drift = analyse_drift(Expected(maps), Observed(tuple((c, kinds[c]) for c in changed.columns)))
    return spark.createDataFrame([(f.category, f.field_id, f.blocking) for f in drift.findings], "category string, field_id string, blocking boolean")


@register("SELECT code, gate FROM (SELECT CASE WHEN (SELECT max(n) FROM (SELECT count(*) n FROM customer GROUP BY c_nationkey)) > 1 AND (SELECT max(n) FROM (SELECT count(*) n FROM supplier GROUP BY s_nationkey)) > 1 THEN 'JOIN_MANY_TO_MANY_APPROVAL_REQUIRED' END AS code, 'join' AS gate UNION ALL SELECT CASE WHEN (SELECT count(DISTINCT o_orderdate) FROM orders) > 250 THEN 'PIVOT_GENERATED_COLUMN_LIMIT' END, 'pivot')")
def plan_gates(spark, sf_dir):
    """The gates that stop a join of many rows to many, and a pivot with too many columns."""
    found = []
    for gate, run in (
        ("join", lambda: join_tables(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), JoinConfig("inner", ["c_nationkey"], ["s_nationkey"]))),
        ("pivot", lambda: pivot_table(table(spark, sf_dir, "orders"), PivotConfig(["o_orderstatus"], ["o_orderdate"], "o_custkey", "count"))),
    ):
        try:
            run()
            found.append((None, gate))
        except PlanError as e:
            found.append((e.code, gate))
    return spark.createDataFrame(found, "code string, gate string")


@register("SELECT n_name AS name, count(*) AS rows FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def split_files(spark, sf_dir):
    """Rows of each output that a split by nation writes, read again from its files."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_name")
    path = fresh_path(spark, "split")
    entries = write_split(split.split_table(rows, split.SplitConfig(["n_name"], mode="csv_files"), ["c_custkey"]), split.SplitConfig(["n_name"], mode="csv_files"), path, TODAY.isoformat())
    counts = spark.read.option("header", True).csv(path).groupBy("n_name").agg(F.count("*").alias("rows"))
    assert sum(e["rows"] for e in entries) == rows.count()
    return counts.select(F.col("n_name").alias("name"), "rows")


@register("SELECT count(*) AS read, count(*) FILTER (c_custkey % 11 <> 0) AS accepted, count(*) FILTER (c_custkey % 11 = 0 AND c_custkey % 7 <> 0) AS rejected, count(*) FILTER (c_custkey % 11 = 0 AND c_custkey % 7 = 0) AS filtered FROM customer")
def reconciled_workflow(spark, sf_dir):
    """Rows read by a workflow are accepted, rejected or filtered, each counted on its own."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as __row_id", "case when c_custkey % 11 = 0 then '' else c_name end as name", "case when c_custkey % 77 = 0 then '' else c_mktsegment end as segment")
    fields = (mapping.Field("name"), mapping.Field("segment"))
    plan = WorkflowPlan("p", mapping.MappingSet(fields, (mapping.Mapping("name", "name"), mapping.Mapping("segment", "segment"))), (Operation("row.remove_blank"), Operation("text.trim", {"field_id": "name"})), rules=(validation.Rule("r", "required", "name", "NAME_MISSING"),))
    result = compile_workflow(c, plan, TODAY)
    counts = reconcile(result)
    result.release()
    return spark.createDataFrame([tuple(counts[k] for k in ("read", "accepted", "rejected", "filtered"))], "read long, accepted long, rejected long, filtered long")
