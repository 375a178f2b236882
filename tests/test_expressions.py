import datetime as dt
import time
from decimal import Decimal

import pytest

from prepweave.errors import PlanError
from prepweave.functions.expressions import REASONS, Calculation, apply_calculation, evaluated, fld, fn, infer_type, lit, referenced_fields

TODAY = dt.date(2026, 7, 17)
T = {"t": "text", "i": "integer", "d": "decimal", "b": "boolean", "day": "date", "n": "text"}
ROW = [("o'neil", "7", "2.5", "yes", "2026-01-31", None)]
D = lambda x: Decimal(x)
i = lambda x: lit(x, "integer")
t = lambda x: lit(x, "text")
# an empty literal is null, the empty text that a function makes is not
EMPTY = fn("substring", t("x"), lit(5, "integer"))
CASES = [
    (fn("add", i(2), i(3)), 5), (fn("subtract", i(2), i(3)), -1), (fn("multiply", lit("1.5", "decimal"), i(2)), D(3)), (fn("divide", i(10), i(4)), D("2.5")),
    (fn("percentage", i(1), i(8)), D("12.5")), (fn("absolute", i(-4)), 4), (fn("round", lit("3.145", "decimal"), i(2)), D("3.15")), (fn("minimum", i(2), i(3)), 2),
    (fn("maximum", i(2), lit("3.5", "decimal")), D("3.5")), (fn("concatenate", t("a"), fn("equal", i(1), i(1)), lit("2.50", "decimal")), "aTrue2.5"), (fn("length", fld("t")), 6),
    (fn("substring", t("abcdef"), i(1), i(3)), "bcd"), (fn("substring", t("abcdef"), i(-2)), "ef"), (fn("starts_with", fld("t"), t("o'")), True), (fn("ends_with", fld("t"), t("x")), False),
    (fn("contains", fld("t"), t("nei")), True), (fn("replace", t("ab"), t(""), t("-")), None), (fn("replace", t("a.b"), t("."), t("")), None),
    (fn("replace", t("ab"), EMPTY, t("$")), "$a$b$"), (fn("replace", t("a.b"), t("."), EMPTY), "ab"), (fn("replace", EMPTY, EMPTY, t("-")), "-"), (fn("coalesce", fld("n"), t("z")), "z"),
    (fn("if", fn("equal", fld("n"), t("x")), i(1), i(2)), 2), (fn("and", fld("b"), fn("equal", fld("n"), t("x"))), None), (fn("or", fld("b"), fn("equal", i(1), i(2))), True), (fn("not", fld("b")), False),
    (fn("equal", i(2), lit("2.0", "decimal")), True), (fn("not_equal", t("a"), t("b")), True), (fn("greater_than", fld("i"), i(6)), True), (fn("less_than", fld("day"), lit("2026-02-01", "date")), True),
    (fn("is_null", fld("n")), True), (fn("is_null", t("")), True), (fn("is_not_null", fld("t")), True), (fn("in", fld("i"), i(7), i(8)), True), (fn("in", fld("t"), t("o'neil"), fld("n")), None),
    (fn("date_difference", lit("2026-03-01", "date"), fld("day")), 29), (fn("add_days", fld("day"), i(1)), dt.date(2026, 2, 1)), (fn("extract_year", fld("day")), 2026), (fn("extract_month", fld("day")), 1),
    (fn("extract_day", fld("day")), 31), (fn("today"), TODAY), (lit("2026-07-01T10:00:00", "datetime"), dt.date(2026, 7, 1)),
]


def test_functions(spark):
    df = spark.createDataFrame(ROW, "t string, i string, d string, b string, day string, n string")
    df, done = evaluated(df, [node for node, _ in CASES], T, TODAY)
    row = df.select(*[c.value.alias(f"v{k}") for k, c in enumerate(done)], *[c.error.alias(f"e{k}") for k, c in enumerate(done)]).first()
    for k, (node, want) in enumerate(CASES):
        got = row[f"v{k}"]
        assert row[f"e{k}"] is None, node
        assert got == want, (node, got, want)


@pytest.mark.parametrize("value", ["9.5", "x", " "])
def test_errors_are_eager(spark, value):
    df = spark.createDataFrame([(value,)], "v string")
    node = fn("if", fn("equal", i(1), i(1)), i(1), fld("v"))
    df, (c,) = evaluated(df, [node], {"v": "integer"}, TODAY)
    assert tuple(df.select(c.value, c.error).first()) == (None, "VALUE_INVALID")


@pytest.mark.parametrize("value,ok", [("2026", False), ("2026-7-1", False), ("2026-02-30", False), ("2026-07-01", True)])
def test_only_iso_dates(spark, value, ok):
    df, (c,) = evaluated(spark.createDataFrame([(value,)], "v string"), [fld("v")], {"v": "date"}, TODAY)
    row = df.select(c.value, c.error).first()
    assert (row[0] is not None) is ok and (row[1] is None) is ok


def test_policies(spark):
    df = spark.createDataFrame([(1, "10", "2"), (2, "10", "0"), (3, "10", "")], "__row_id long, a string, b string")
    types = {"a": "integer", "b": "integer"}
    make = lambda policy: Calculation("c", "r", "decimal", fn("divide", fld("a"), fld("b")), error_policy=policy, reason_code="ZERO")
    rows = apply_calculation(df, make("reject_row"), types, TODAY).orderBy("__row_id").collect()
    assert [(r["r"], r[REASONS]) for r in rows] == [(D(5), []), (None, ["ZERO"]), (None, [])]
    rows = apply_calculation(df, make("set_null"), types, TODAY).orderBy("__row_id").collect()
    assert [r[REASONS] for r in rows] == [[], [], []]
    with pytest.raises(PlanError, match="CALCULATION_STOPPED"):
        apply_calculation(df, make("stop"), types, TODAY)


def test_types():
    with pytest.raises(PlanError, match="EXPRESSION_TYPE_INVALID"):
        infer_type(fn("add", t("a"), i(1)), {})
    with pytest.raises(PlanError, match="EXPRESSION_FUNCTION_UNKNOWN"):
        infer_type(fn("eval", t("a")), {})
    deep = i(1)
    for _ in range(33):
        deep = fn("absolute", deep)
    with pytest.raises(PlanError, match="EXPRESSION_TOO_DEEP"):
        infer_type(deep, {})
    assert referenced_fields(fn("add", fld("a"), fn("length", fld("b")))) == {"a", "b"}


def test_deep_expressions(spark):
    """A plan grows with the number of calls, not with that of the paths to them."""
    node = fld("v")
    for k in range(31):
        node = fn("subtract", node, i(1)) if k % 2 else fn("maximum", node, node)
    df, (c,) = evaluated(spark.createDataFrame([("40",), ("x",)], "v string"), [node], {"v": "integer"}, TODAY)
    out = df.select(c.value.alias("v"), c.error.alias("e"))
    began = time.perf_counter()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - began < 5 and len(plan) < 200_000
    assert [tuple(r) for r in out.collect()] == [(25, None), (None, "VALUE_INVALID")]


@pytest.mark.parametrize("places,want", [(-7, "120000000"), (-6, "123000000"), (-8, "100000000"), (-9, "0"), (-40, "0"), (0, "123456789"), (9, "123456789.123456")])
def test_round_to_any_place(spark, places, want):
    df, (c,) = evaluated(spark.range(1), [fn("round", lit("123456789.123456", "decimal"), i(places))], {}, TODAY)
    assert df.select(c.value).first()[0] == D(want)
