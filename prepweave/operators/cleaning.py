"""The registered cleaning operations. Each takes (DataFrame, config) and returns a DataFrame."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.functions import text

ROW_ID = "__row_id"


def slug(label: str) -> str:
    """A stable field id: ASCII letters, digits and underscores, at most 80, not beginning with a digit."""
    plain = unicodedata.normalize("NFKD", label).encode("ascii", "ignore").decode().lower()
    found = re.sub(r"[^a-z0-9]+", "_", plain).strip("_") or "field"
    return (f"field_{found}" if found[0].isdigit() else found)[:80]


def need(df: DataFrame, fields: list[str], code: str) -> None:
    if missing := [f for f in fields if f not in df.columns]:
        raise PlanError(code, ", ".join(missing))


def _on_text(change: Callable[[Column], Column]):
    """A change of one field; null becomes empty text before it."""

    def run(df: DataFrame, config: dict) -> DataFrame:
        need(df, [config["field_id"]], "OPERATION_FIELD_NOT_FOUND")
        name = config["field_id"]
        return df.withColumn(name, change(F.coalesce(F.col(name).cast("string"), F.lit(""))))

    return run


def _normalise_nulls(df: DataFrame, config: dict) -> DataFrame:
    values = tuple(config.get("null_like_values") or text.NULL_LIKE)
    return _on_text(lambda c: text.normalise_nulls(c, values))(df, config)


def _rename(df: DataFrame, config: dict) -> DataFrame:
    old, new = config["field_id"], config["new_field_id"]
    need(df, [old], "OPERATION_FIELD_NOT_FOUND")
    if slug(new) != new:
        raise PlanError("OPERATION_FIELD_ID_INVALID", new)
    if new in df.columns and new != old:
        raise PlanError("OPERATION_FIELD_EXISTS", new)
    return df.withColumnRenamed(old, new)


def _select(df: DataFrame, config: dict) -> DataFrame:
    fields = [f for f in config["field_ids"] if f != ROW_ID]
    need(df, fields, "OPERATION_FIELD_NOT_FOUND")
    return df.select(*[c for c in (ROW_ID,) if c in df.columns], *fields)


def _reorder(df: DataFrame, config: dict) -> DataFrame:
    first = [c for c in (ROW_ID,) if c in df.columns] + [f for f in config["field_ids"] if f != ROW_ID]
    need(df, first, "OPERATION_FIELD_NOT_FOUND")
    return df.select(*first, *[c for c in df.columns if c not in first])


def _filled(df: DataFrame, config: dict) -> Column:
    fields = config.get("field_ids") or [c for c in df.columns if not c.startswith("__")]
    need(df, fields, "OPERATION_FIELD_NOT_FOUND")
    return reduce(lambda a, b: a | b, [F.col(f).isNotNull() & (F.col(f).cast("string") != "") for f in fields], F.lit(False))


def _no_header(df: DataFrame, config: dict) -> Column:
    """A null never equals a header, so such a row stays."""
    values: dict[str, str] = config.get("header_values") or {}
    need(df, list(values), "OPERATION_FIELD_NOT_FOUND")
    same = reduce(lambda a, b: a & b, [F.lower(F.col(f).cast("string")) == v.lower() for f, v in values.items()], F.lit(bool(values)))
    return ~F.coalesce(same, F.lit(False))


#: Operations that remove rows: which rows they keep.
KEEPS: dict[str, Callable[[DataFrame, dict], Column]] = {"row.remove_blank": _filled, "row.remove_repeated_headers": _no_header}
GROUPS = "group.aggregate"


def _aggregate(df: DataFrame, config: dict) -> DataFrame:
    """Groups in the order in which they are first seen; the result's rows get new numbers."""
    number = lambda f: F.expr(f"try_cast(`{f}` as double)")
    makers = {
        "sum": lambda f: F.coalesce(F.sum(number(f)), F.lit(0.0)),
        "minimum": lambda f: F.min(number(f)),
        "maximum": lambda f: F.max(number(f)),
        "mean": lambda f: F.avg(number(f)),
        "count": lambda f: F.count(F.col(f)),
    }
    groups = config["group_by"]
    need(df, [*groups, *[a["field_id"] for a in config["aggregates"]]], "OPERATION_FIELD_NOT_FOUND")
    if unknown := [a["function"] for a in config["aggregates"] if a["function"] not in makers]:
        raise PlanError("OPERATION_AGGREGATE_UNSUPPORTED", ", ".join(unknown))
    order = [F.min(ROW_ID).alias("__first")] if ROW_ID in df.columns else []
    out = df.groupBy(*groups).agg(*[makers[a["function"]](a["field_id"]).alias(a["output_field_id"]) for a in config["aggregates"]], *order)
    if not order:
        return out
    from pyspark.sql.window import Window as W

    numbered = out.withColumn(ROW_ID, F.row_number().over(W.orderBy("__first")).cast("long"))  # one row a group
    return numbered.select(ROW_ID, *groups, *[a["output_field_id"] for a in config["aggregates"]])


OPERATIONS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "text.trim": _on_text(text.trim),
    "text.normalise_spaces": _on_text(text.normalise_spaces),
    "text.uppercase": _on_text(F.upper),
    "text.lowercase": _on_text(F.lower),
    "text.proper_case": _on_text(text.proper_case),
    "text.remove_non_printable": _on_text(text.remove_non_printable),
    "text.normalise_nulls": _normalise_nulls,
    "field.rename": _rename,
    "field.select": _select,
    "field.reorder": _reorder,
    **{name: lambda df, config, keep=keep: df.filter(keep(df, config)) for name, keep in KEEPS.items()},
    GROUPS: _aggregate,
}


@dataclass(frozen=True)
class Operation:
    operation_id: str
    config: dict[str, Any] = field(default_factory=dict)
    operation_version: int = 1
    enabled: bool = True
    node_id: str = ""


def apply_operation(df: DataFrame, operation: Operation) -> DataFrame:
    """One operation of the registry; a disabled one changes nothing."""
    if not operation.enabled:
        return df
    if operation.operation_id not in OPERATIONS:
        raise PlanError("OPERATION_NOT_FOUND", operation.operation_id)
    if operation.operation_version != 1:
        raise PlanError("OPERATION_VERSION_UNSUPPORTED", f"{operation.operation_id} {operation.operation_version}")
    return OPERATIONS[operation.operation_id](df, operation.config)


def observed(df: DataFrame, dropped: Column | None = None) -> tuple[DataFrame, Observation]:
    """Counts the rows that pass, and those of them for which dropped holds, in whatever job reads them first, without a pass
    of its own."""
    seen = Observation()
    gone = F.lit(0).cast("long") if dropped is None else F.count_if(dropped)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), (gone if dropped is not None else F.max(gone)).alias("dropped")), seen


def affected_rows(before: DataFrame, operation: Operation) -> DataFrame:
    """How many rows of the changed field an operation on text changes; a null that becomes empty text counts."""
    after = apply_operation(before.withColumn("__before", F.col(operation.config["field_id"])), operation)
    return after.agg(F.count_if(~F.col("__before").cast("string").eqNullSafe(F.col(operation.config["field_id"]))).alias("affected"))
