"""Pivot and unpivot."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.operators.aggregate import measure
from prepweave.operators.append import supertype


@dataclass(frozen=True)
class PivotConfig:
    row_fields: list[str]
    column_fields: list[str]
    value_field: str
    aggregation: str = "sum"
    fill_value: Any = None
    sort_columns: bool = True
    maximum_generated_columns: int = 250


@dataclass(frozen=True)
class UnpivotConfig:
    identifier_fields: list[str]
    value_fields: list[str]
    variable_field_name: str = "variable"
    value_field_name: str = "value"
    null_row_handling: str = "drop"


def pivot_table(df: DataFrame, config: PivotConfig, order: list[str] | None = None) -> DataFrame:
    """A row per value of the row fields, a column per value of the column fields (joined by two underscores).

    The column keys are read first, at most one more than allowed; given to pivot() they make the aggregation one job
    that combines before its shuffle. A cell without rows is 0 for sum, count and unique_count, null otherwise; fill
    replaces null in generated columns only. count counts rows, nulls too.
    """
    if missing := [f for f in (*config.row_fields, *config.column_fields, config.value_field) if f not in df.columns]:
        raise PlanError("PIVOT_FIELDS_NOT_FOUND", ", ".join(missing))
    name = F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in config.column_fields]), "__")
    keyed = df.withColumn("__pivot", name)
    keys = [r[0] for r in keyed.select("__pivot").distinct().limit(config.maximum_generated_columns + 1).collect()]
    if len(keys) > config.maximum_generated_columns:
        raise PlanError("PIVOT_GENERATED_COLUMN_LIMIT", str(config.maximum_generated_columns))
    if not config.sort_columns:
        first = keyed.groupBy("__pivot").agg(F.min(F.struct(*(order or config.column_fields))).alias("at")).orderBy("at", "__pivot")
        keys = [r["__pivot"] for r in first.collect()]
    else:
        keys.sort()
    value = F.col(f"`{config.value_field}`")
    cell = F.count(F.lit(1)) if config.aggregation == "count" else measure(config.aggregation, value, order or [])
    if not keys:
        return keyed.select(*config.row_fields).distinct()
    out = keyed.groupBy(*config.row_fields).pivot("__pivot", keys).agg(cell)

    def filled(c: str) -> Column:
        x = F.col(f"`{c}`")
        if config.aggregation in ("sum", "count", "unique_count"):
            x = F.coalesce(x, F.lit(0).cast(out.schema[c].dataType))
        return x if config.fill_value is None else F.coalesce(x, F.lit(config.fill_value).cast(out.schema[c].dataType))

    return out.select(*config.row_fields, *[filled(c).alias(c) for c in keys])


def unpivot_table(df: DataFrame, config: UnpivotConfig) -> DataFrame:
    """A row per value field; values of different types become the type that holds all. Lineage columns go."""
    if missing := [f for f in (*config.identifier_fields, *config.value_fields) if f not in df.columns]:
        raise PlanError("UNPIVOT_FIELDS_NOT_FOUND", ", ".join(missing))
    kind = df.schema[config.value_fields[0]].dataType
    for f in config.value_fields[1:]:
        kind = supertype(kind, df.schema[f].dataType)
    same = df.select(*config.identifier_fields, *[F.col(f"`{f}`").cast(kind).alias(f) for f in config.value_fields])
    out = same.unpivot(config.identifier_fields, config.value_fields, config.variable_field_name, config.value_field_name)
    return out.filter(F.col(config.value_field_name).isNotNull()) if config.null_row_handling == "drop" else out
