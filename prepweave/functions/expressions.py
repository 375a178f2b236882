"""The closed expression language: static types, and a compiler to columns for the values and the errors of all parts.

Evaluation is eager: an error in any argument fails the row, even in a branch that is not taken. Every function but
today, is_null, is_not_null, coalesce and if gives null as soon as one argument is null.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.errors import PlanError

DEPTH = 32
SPARK = {"text": "string", "integer": "bigint", "decimal": "decimal(18,6)", "boolean": "boolean", "date": "date"}
NUMERIC = {"integer", "decimal"}


@dataclass(frozen=True)
class Node:
    """kind: field (name), literal (value, data_type) or function (name, arguments)."""

    kind: str
    name: str | None = None
    value: Any = None
    data_type: str | None = None
    arguments: tuple["Node", ...] = ()

    def __post_init__(self):
        shapes = {
            "field": self.name and not self.arguments,
            "literal": self.data_type in (*SPARK, "datetime") and not self.arguments,
            "function": self.name and self.data_type is None,
        }
        if not shapes.get(self.kind):
            raise PlanError("EXPRESSION_NODE_INVALID", self.kind)


def fld(name: str) -> Node:
    return Node("field", name)


def lit(value: Any, data_type: str) -> Node:
    return Node("literal", value=value, data_type=data_type)


def fn(name: str, *arguments: Node) -> Node:
    return Node("function", name, arguments=arguments)


@dataclass(frozen=True)
class Compiled:
    """value is null where error is not; error is null or names what failed."""

    value: Column
    error: Column
    data_type: str


def _alike(types: list[str]) -> bool:
    return len(set(types)) == 1 or set(types) <= NUMERIC


def _wider(types: list[str]) -> str:
    return types[0] if len(set(types)) == 1 else "decimal"


def typed(raw: Column, data_type: str) -> tuple[Column, Column]:
    """A field's or literal's value in its type, and where it cannot be one. Empty text is null."""
    s = raw.cast("string")
    empty = F.coalesce(s, F.lit("")) == ""
    trimmed = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    if data_type == "text":
        value = s
    elif data_type == "integer":
        value = F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("bigint"))
    elif data_type == "decimal":
        value = trimmed.try_cast("decimal(18,6)")
    elif data_type == "boolean":
        low = F.lower(trimmed)
        value = F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
    else:
        day = F.substring(trimmed, 1, 10) if data_type == "datetime" else trimmed  # a time of day is cut off
        value = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))
    value = F.when(~empty, value)
    return value, F.when(~empty & value.isNull(), F.lit("VALUE_INVALID"))


def result_type(name: str, types: list[str]) -> str:
    """The static type of a call, or an error that names the function."""

    def check(ok: bool) -> None:
        if not ok:
            raise PlanError("EXPRESSION_TYPE_INVALID", f"{name}({', '.join(types)})")

    n = len(types)
    if name in ("add", "subtract", "multiply", "minimum", "maximum"):
        check(n == 2 and set(types) <= NUMERIC)
        return _wider(types)
    if name in ("divide", "percentage"):
        check(n == 2 and set(types) <= NUMERIC)
        return "decimal"
    if name == "absolute":
        check(n == 1 and set(types) <= NUMERIC)
        return types[0]
    if name == "round":
        check(n in (1, 2) and types[0] in NUMERIC and types[1:] in ([], ["integer"]))
        return "decimal"
    if name == "concatenate":
        check(n >= 2)
        return "text"
    if name == "length":
        check(types == ["text"])
        return "integer"
    if name == "substring":
        check(n in (2, 3) and types[0] == "text" and set(types[1:]) == {"integer"})
        return "text"
    if name in ("starts_with", "ends_with", "contains"):
        check(types == ["text", "text"])
        return "boolean"
    if name == "replace":
        check(types == ["text"] * 3)
        return "text"
    if name == "coalesce":
        check(n >= 2 and _alike(types))
        return _wider(types)
    if name == "if":
        check(n == 3 and types[0] == "boolean" and _alike(types[1:]))
        return _wider(types[1:])
    if name in ("and", "or"):
        check(n >= 2 and set(types) == {"boolean"})
        return "boolean"
    if name == "not":
        check(types == ["boolean"])
        return "boolean"
    if name in ("equal", "not_equal", "greater_than", "less_than"):
        check(n == 2 and _alike(types))
        return "boolean"
    if name in ("is_null", "is_not_null"):
        check(n == 1)
        return "boolean"
    if name == "in":
        check(n >= 2 and _alike(types))
        return "boolean"
    if name == "date_difference":
        check(types == ["date", "date"])
        return "integer"
    if name == "add_days":
        check(types == ["date", "integer"])
        return "date"
    if name in ("extract_year", "extract_month", "extract_day"):
        check(types == ["date"])
        return "integer"
    if name == "today":
        check(n == 0)
        return "date"
    raise PlanError("EXPRESSION_FUNCTION_UNKNOWN", name)


def infer_type(node: Node, types: dict[str, str], depth: int = 1) -> str:
    if depth > DEPTH:
        raise PlanError("EXPRESSION_TOO_DEEP", str(DEPTH))
    if node.kind == "field":
        if node.name not in types:
            raise PlanError("EXPRESSION_FIELD_UNKNOWN", node.name)
        return "date" if types[node.name] == "datetime" else types[node.name]
    if node.kind == "literal":
        return "date" if node.data_type == "datetime" else node.data_type
    return result_type(node.name, [infer_type(a, types, depth + 1) for a in node.arguments])


def _shown(x: Compiled) -> Column:
    """A value as text: booleans as True and False, decimals without trailing zeros."""
    if x.data_type == "boolean":
        return F.when(x.value, "True").otherwise("False")
    if x.data_type == "decimal":
        return F.regexp_replace(F.regexp_replace(x.value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return x.value.cast("string")


def _substring(c: Column, start: Column, length: Column | None) -> Column:
    """From a place counted from 0; a negative one counts from the end, as does a negative end."""
    n = F.length(c)
    clip = lambda i: F.greatest(F.lit(0), F.least(n, F.when(i < 0, n + i).otherwise(i)))
    begin = clip(start)
    end = n if length is None else clip(start + length)
    return F.substring(c, (begin + 1).cast("int"), F.greatest(F.lit(0), end - begin).cast("int"))


def _replace(c: Column, old: Column, new: Column) -> Column:
    """An empty search text matches before each character and at the end."""
    each = F.regexp_replace(c, F.lit(r"(?s)(?=.)|$"), F.regexp_replace(new, r"([\\$])", r"\\$1"))
    return F.when(old == "", each).otherwise(F.replace(c, old, new))


def _call(name: str, a: list[Compiled], kind: str, today: dt.date) -> tuple[Column, Column | None]:
    """The value for arguments without nulls and errors, and the call's own error."""
    v = [x.value for x in a]
    target = SPARK[kind]
    numbers = [x.value.cast("decimal(18,6)") if kind == "decimal" and x.data_type in NUMERIC else x.value for x in a]
    if name in ("add", "subtract", "multiply"):
        made = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply}[name](*numbers).try_cast(target)
        return made, F.when(made.isNull(), F.lit("NUMBER_OVERFLOW"))
    if name in ("divide", "percentage"):
        x, y = [c.cast("decimal(18,6)") for c in v]
        made = F.try_divide(x * 100 if name == "percentage" else x, y).try_cast(target)
        return made, F.when(y == 0, F.lit("DIVISION_BY_ZERO")).when(made.isNull(), F.lit("NUMBER_OVERFLOW"))
    if name == "absolute":
        return F.abs(v[0]), None
    if name == "round":
        x = v[0].cast("decimal(18,6)")
        places = a[1].value if len(a) > 1 else F.lit(0)
        # a decimal(18,6) has 12 digits before the point and 6 behind it
        made = F.when(places < -12, F.lit(0).cast(target)).otherwise(x)
        made = reduce(lambda other, n: F.when(places == n, F.round(x, n).cast(target)).otherwise(other), range(-12, 6), made)
        return made.try_cast(target), None
    if name in ("minimum", "maximum"):
        return (F.least if name == "minimum" else F.greatest)(*numbers), None
    if name == "concatenate":
        return F.concat(*map(_shown, a)), None
    if name == "length":
        return F.length(v[0]).cast("bigint"), None
    if name == "substring":
        return _substring(v[0], v[1], v[2] if len(v) > 2 else None), None
    if name in ("starts_with", "ends_with", "contains"):
        return {"starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains}[name](*v), None
    if name == "replace":
        return _replace(*v), None
    if name in ("and", "or"):
        return reduce((lambda x, y: x & y) if name == "and" else (lambda x, y: x | y), v), None
    if name == "not":
        return ~v[0], None
    if name in ("equal", "not_equal", "greater_than", "less_than"):
        return {"equal": v[0] == v[1], "not_equal": v[0] != v[1], "greater_than": v[0] > v[1], "less_than": v[0] < v[1]}[name], None
    if name == "in":
        return reduce(lambda x, y: x | y, [v[0] == y for y in v[1:]]), None
    if name == "date_difference":
        return F.datediff(*v).cast("bigint"), None
    if name == "add_days":
        small = v[1].between(-3_660_000, 3_660_000)
        made = F.date_add(v[0], F.when(small, v[1]).otherwise(0).cast("int"))
        return made, F.when(~small, F.lit("DATE_OVERFLOW"))
    part = {"extract_year": F.year, "extract_month": F.month, "extract_day": F.dayofmonth}[name]
    return part(v[0]).cast("bigint"), None


class Steps:
    """An expression as steps that each add columns to a table: a call names its arguments' columns, so that a plan grows with
    the number of calls and not with the number of paths to them. A part that stands in several places is one
    column."""

    def __init__(self, types: dict[str, str], today: dt.date, prefix: str):
        self.types, self.today, self.prefix = types, today, prefix
        self.levels: list[dict[str, Column]] = []
        self.known: dict[int, tuple[Compiled, int]] = {}

    def add(self, node: Node) -> tuple[Compiled, int]:
        """The columns of a part, and the step that makes them."""
        if id(node) not in self.known:
            below = [self.add(x) for x in node.arguments]
            level = max([0, *(n + 1 for _, n in below)])
            made = _compiled(node, [c for c, _ in below], self.types, self.today)
            names = [f"{self.prefix}{len(self.known)}_{part}" for part in ("value", "error")]
            self.levels += [{}] * (level + 1 - len(self.levels))
            self.levels[level] = self.levels[level] | dict(zip(names, (made.value, made.error)))
            self.known[id(node)] = Compiled(F.col(names[0]), F.col(names[1]), made.data_type), level
        return self.known[id(node)]


def evaluated(df: DataFrame, nodes: list[Node], types: dict[str, str], today: dt.date, prefix: str = "__step") -> tuple[DataFrame, list[Compiled]]:
    """The table with columns for the expressions and their parts, whose names begin with the prefix, and the expressions'
    values and errors as columns of it. types gives the fields' types. today is the plan's date, never the clock's."""
    for node in nodes:
        infer_type(node, types)
    steps = Steps(types, today, prefix)
    done = [steps.add(node)[0] for node in nodes]
    for columns in steps.levels:
        df = df.withColumns(columns)
    return df, done


def without_steps(df: DataFrame, prefix: str = "__step") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def _compiled(node: Node, a: list[Compiled], types: dict[str, str], today: dt.date) -> Compiled:
    """One node over the columns of its arguments."""
    if node.kind == "field":
        value, error = typed(F.col(f"`{node.name}`"), types[node.name])
        return Compiled(value, error, infer_type(node, types))
    if node.kind == "literal":
        raw = None if node.value is None else str(node.value)
        value, error = typed(F.lit(raw), node.data_type)
        return Compiled(value, error, infer_type(node, types))
    kind = result_type(node.name, [x.data_type for x in a])
    failed = F.coalesce(*[x.error for x in a]) if a else F.lit(None).cast("string")
    if node.name == "today":
        return Compiled(F.lit(today), F.lit(None).cast("string"), kind)
    if node.name in ("is_null", "is_not_null", "coalesce", "if"):
        v = [x.value.cast(SPARK[kind]) if node.name in ("coalesce", "if") and x.data_type in NUMERIC else x.value for x in a]
        made = {"is_null": lambda: v[0].isNull(), "is_not_null": lambda: v[0].isNotNull(), "coalesce": lambda: F.coalesce(*v), "if": lambda: F.when(F.coalesce(v[0], F.lit(False)), v[1]).otherwise(v[2])}[node.name]()
        return Compiled(F.when(failed.isNull(), made), failed, kind)
    made, own = _call(node.name, a, kind, today)
    ready = reduce(lambda x, y: x & y, [x.value.isNotNull() for x in a]) & failed.isNull()
    error = failed if own is None else F.coalesce(failed, F.when(ready, own))
    return Compiled(F.when(ready & error.isNull() if own is not None else ready, made), error, kind)


def referenced_fields(node: Node) -> set[str]:
    return {node.name} if node.kind == "field" else set().union(*map(referenced_fields, node.arguments)) if node.arguments else set()


@dataclass(frozen=True)
class Calculation:
    calculation_id: str
    output_canonical_field: str
    output_type: str
    expression: Node
    error_policy: str = "reject_row"
    reason_code: str = "CALCULATION_FAILED"
    version: int = 1
    description: str = ""
    null_policy: str = "propagate"


REASONS = "__calculation_reasons"


def apply_calculation(df: DataFrame, config: Calculation, types: dict[str, str], today: dt.date) -> DataFrame:
    """Adds the output field. A row whose expression fails gets null; with reject_row its reason joins __calculation_reasons,
    with stop any such row ends the plan (one job looks for it)."""
    kind = infer_type(config.expression, types)
    wanted = "date" if config.output_type == "datetime" else config.output_type
    if not _alike([kind, wanted]):
        raise PlanError("CALCULATION_TYPE_MISMATCH", f"{config.calculation_id}: {kind}, not {wanted}")
    if config.error_policy not in ("set_null", "reject_row", "stop"):
        raise PlanError("CALCULATION_POLICY_UNSUPPORTED", config.error_policy)
    out, (done,) = evaluated(df, [config.expression], types, today)
    out = without_steps(out.withColumns({"__value": done.value, "__error": done.error}))
    if config.error_policy == "stop" and not out.filter("__error is not null").isEmpty():
        raise PlanError("CALCULATION_STOPPED", config.calculation_id)
    before = F.col(REASONS) if REASONS in df.columns else F.array().cast("array<string>")
    reasons = F.when(F.col("__error").isNotNull() & F.lit(config.error_policy == "reject_row"), F.concat(before, F.array(F.lit(config.reason_code)))).otherwise(before)
    return out.withColumns({REASONS: reasons, config.output_canonical_field: F.col("__value")}).drop("__value", "__error")
