"""Grouped aggregation with the stages that follow it: share of total, sort, rank, running total, top n."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from prepweave.errors import PlanError
from prepweave.operators.cleaning import ROW_ID
from prepweave.operators.mapping import with_row_ids
from prepweave.operators.quantiles import exact_percentiles
from prepweave.tables import fits_task, running_total, written

#: Grouped rows that one task sorts and adds up; checked by a count.
FEW = 100_000
FUNCTIONS = ("sum", "count", "unique_count", "average", "minimum", "maximum", "median", "first", "last")


@dataclass(frozen=True)
class Measure:
    field_id: str
    function: str
    output_field_id: str
    null_handling: str = "ignore"


@dataclass(frozen=True)
class AggregateConfig:
    group_fields: list[str]
    measures: list[Measure]
    sort_fields: list[str] = field(default_factory=list)
    descending: bool = False
    top_n: int | None = None
    percentage_of_total_fields: list[str] = field(default_factory=list)
    rank_field: str | None = None
    rank_output_field: str = "rank"
    running_total_field: str | None = None
    running_total_output_field: str = "running_total"


def measure(function: str, c: Column, order: list[str]) -> Column:
    """An aggregate over a group. A sum of nulls is 0, a null counts as one different value, first and last follow order."""
    place = F.struct(*[F.col(f"`{o}`") for o in order]) if order else None
    if function in ("first", "last") and place is None:
        raise PlanError("AGGREGATION_ORDER_REQUIRED", function)
    makers = {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "count": lambda: F.count(c),
        "unique_count": lambda: F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0)),
        "average": lambda: F.avg(c),
        "minimum": lambda: F.min(c),
        "maximum": lambda: F.max(c),
        "median": lambda: F.median(c),
        "first": lambda: F.min_by(c, place),
        "last": lambda: F.max_by(c, place),
    }
    if function not in makers:
        raise PlanError("AGGREGATION_FUNCTION_UNSUPPORTED", function)
    return makers[function]()


def aggregate_table(df: DataFrame, config: AggregateConfig, order: list[str] | None = None) -> DataFrame:
    """Groups and measures, then share of total, sort, dense rank, running total and top n, in this order.

    order names the fields that order the input's rows, for first and last. The stages after grouping run on the aggregated
    rows, which shares, ranks and totals read from one written result: up to FEW rows in one task, more in all tasks (ranks
    number the different values by range, a running total adds the totals of the ranges before).
    """
    fields = [*config.group_fields, *[m.field_id for m in config.measures]]
    if not config.group_fields or not config.measures or any(f not in df.columns for f in fields):
        raise PlanError("AGGREGATION_FIELDS_NOT_FOUND", ", ".join(f for f in fields if f not in df.columns))
    measures, checks = [], []
    for m in config.measures:
        kind = df.schema[m.field_id].dataType
        numeric = isinstance(kind, T.NumericType)
        if m.function in ("sum", "average") and not numeric:
            raise PlanError("AGGREGATION_TYPE_INVALID", m.field_id)
        c = F.col(f"`{m.field_id}`")
        if m.null_handling == "zero":
            if not numeric:
                raise PlanError("AGGREGATION_TYPE_INVALID", m.field_id)
            c = F.coalesce(c, F.lit(0).cast(kind))
        elif m.null_handling == "error":
            checks.append(m.field_id)
        measures.append(measure(m.function, c, order or []).alias(m.output_field_id))
    if checks and (row := df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in checks]).first()) and any(row):
        raise PlanError("AGGREGATION_NULL_VALUES", ", ".join(c for c in checks if row[c]))
    out = _grouped(df, config, measures)
    names = out.columns
    for f in (*config.percentage_of_total_fields, *config.sort_fields, *[x for x in (config.rank_field, config.running_total_field) if x]):
        _known(f, names + [f"{c}_percentage_of_total" for c in config.percentage_of_total_fields])
    few = False
    if config.percentage_of_total_fields or config.rank_field or config.running_total_field:
        out = written(out, "grouped")
        few = out.count() <= FEW  # so many rows are sorted and added up in one task; more of them by ranges
    for f in config.percentage_of_total_fields:
        total = out.agg(F.sum(f"`{f}`").cast("double")).scalar()
        out = out.withColumn(f"{f}_percentage_of_total", F.try_divide(F.col(f"`{f}`").cast("double"), total) * 100)
    way = (lambda c: F.col(c).desc_nulls_first()) if config.descending else (lambda c: F.col(c).asc_nulls_first())
    sort = [way(c) for c in (config.sort_fields or config.group_fields)] + [F.col(c).asc_nulls_first() for c in config.group_fields]
    if config.rank_field:
        c, name = F.col(config.rank_field), config.rank_output_field
        if few:
            place = F.dense_rank().over(W.orderBy(c.desc_nulls_last() if config.descending else c.asc_nulls_last())).cast("long")
            out = out.withColumn(name, F.when(c.isNotNull(), place))
        else:
            values = out.filter(c.isNotNull()).select(c.alias("__value")).distinct()
            places = with_row_ids(values, [F.desc("__value") if config.descending else F.asc("__value")])
            out = out.join(places, c == F.col("__value"), "left").select(*out.columns, F.col(ROW_ID).alias(name))
    if config.running_total_field:
        c, name = F.col(config.running_total_field), config.running_total_output_field
        if few:
            out = out.withColumn(name, F.sum(c).over(W.orderBy(*sort).rowsBetween(W.unboundedPreceding, 0)))
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
        else:
            out = running_total(out, c, name, sort)
        out = out.withColumn(name, F.when(c.isNotNull(), F.col(name)))
    out = out.orderBy(*sort)
    return out.limit(config.top_n) if config.top_n else out


def _grouped(df: DataFrame, config: AggregateConfig, measures: list[Column]) -> DataFrame:
    """The groups with their measures. Medians are aggregated with the rest where the whole input fits a task; else groups
    are counted first, and large ones get theirs by selection."""
    medians = [(i, m) for i, m in enumerate(config.measures) if m.function == "median"]
    if not medians or fits_task(df):
        return df.groupBy(*config.group_fields).agg(*measures)
    filled = lambda m: F.coalesce(F.col(f"`{m.field_id}`"), F.lit(0)) if m.null_handling == "zero" else F.col(f"`{m.field_id}`")
    rest = [c for c, m in zip(measures, config.measures) if m.function != "median"]
    out = written(df.groupBy(*config.group_fields).agg(*rest, *[F.count(filled(m)).alias(f"__n{i}") for i, m in medians]), "grouped")
    for i, m in medians:
        values = df.withColumn("__value", filled(m))
        found = exact_percentiles(values, config.group_fields, "__value", [0.5], counts=out.select(*config.group_fields, F.col(f"__n{i}").alias("n")))
        found = found.select(*[F.col(f"`{g}`").alias(f"__g{k}") for k, g in enumerate(config.group_fields)], F.col("p0").alias(m.output_field_id))
        same = [F.col(f"`{g}`").eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(config.group_fields)]
        out = out.join(found, same, "left").drop(*[f"__g{k}" for k in range(len(same))])
    return out.select(*config.group_fields, *[F.col(f"`{m.output_field_id}`") for m in config.measures])


def _known(name: str, names: list[str]) -> None:
    if name not in names:
        raise PlanError("AGGREGATION_FIELDS_NOT_FOUND", name)
