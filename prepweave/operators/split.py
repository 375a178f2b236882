"""Splitting a table by the values of fields: keys, conditions, small groups, chunks, safe names."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepweave.errors import PlanError
from prepweave.functions.expressions import Node, evaluated, infer_type, without_steps
from prepweave.tables import numbered_within

MODES = ("excel_files", "excel_sheets", "csv_files", "zip_package")
LARGEST_CHUNK = 1_048_575
#: Names that file systems reserve.
RESERVED = {"con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10))}


@dataclass(frozen=True)
class SplitConfig:
    fields: list[str] = field(default_factory=list)
    date_part: str = "none"
    maximum_rows_per_file: int | None = None
    condition: Node | None = None
    minimum_group_size: int = 1
    mode: str = "excel_files"
    naming_template: str = "{split_value}"
    project_label: str = ""
    report_type: str = ""

    def __post_init__(self):
        if self.date_part not in ("none", "year", "month", "quarter") or self.mode not in MODES:
            raise PlanError("SPLIT_CONFIG_INVALID")
        if self.maximum_rows_per_file is not None and not 1 <= self.maximum_rows_per_file <= LARGEST_CHUNK:
            raise PlanError("SPLIT_CONFIG_INVALID", "maximum_rows_per_file")


def canonical_types(df: DataFrame) -> dict[str, str]:
    """The expression language's type of each column."""

    def kind(t: T.DataType) -> str:
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.IntegralType):
            return "integer"
        if isinstance(t, T.NumericType):
            return "decimal"
        return "date" if isinstance(t, T.DateType) else "datetime" if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else "text"

    return {f.name: kind(f.dataType) for f in df.schema}


def _part(c: Column, date_part: str) -> Column:
    """Year, year and month, or year and quarter of a text that begins with YYYY-MM; other texts stay."""
    s = c.cast("string")
    year, month = F.substring(s, 1, 4), F.substring(s, 6, 2)
    quarter = F.concat(year, F.lit("-Q"), F.ceil(month.try_cast("int") / 3).cast("string"))
    made = {"year": year, "month": F.substring(s, 1, 7), "quarter": quarter}[date_part]
    return F.when(s.rlike(r"^\d{4}-(0[1-9]|1[0-2])"), made).otherwise(s)


def split_table(df: DataFrame, config: SplitConfig, order: list[str], today=None) -> DataFrame:
    """The rows that the split keeps, with __split_key (its name) and __chunk (from 1).

    Rows are grouped by the fields themselves, so keys of the same name stay apart: __split_group tells them apart.
    A condition keeps the rows for which it is true. Groups below the least size go. With a largest size a group is cut
    in the order of `order`, which is written by range first, so that a large group is many tasks.
    """
    if missing := [f for f in config.fields if f not in df.columns]:
        raise PlanError("SPLIT_FIELDS_NOT_FOUND", ", ".join(missing))
    out = df
    if config.condition is not None:
        types = canonical_types(df)
        if infer_type(config.condition, types) != "boolean":
            raise PlanError("SPLIT_CONDITION_MUST_BE_BOOLEAN")
        out, (condition,) = evaluated(out, [config.condition], types, today)
        out = without_steps(out.filter(condition.value))
    parts = [F.col(f"`{f}`").cast("string") for f in config.fields]
    if config.fields and config.date_part != "none":
        parts[0] = _part(F.col(f"`{config.fields[0]}`"), config.date_part)
    keys = {f"__k{i}": p for i, p in enumerate(parts)}
    out = out.withColumns(keys) if keys else out
    name = F.array_join(F.array(*[F.coalesce(F.col(k), F.lit("null")) for k in keys]), "__") if keys else F.lit("all")
    group = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    out = out.withColumn("__split_key", name).withColumn("__split_group", group)
    if config.minimum_group_size > 1:
        sizes = out.groupBy("__split_group").agg(F.count("*").alias("__n")).filter(F.col("__n") >= config.minimum_group_size)
        out = out.join(sizes.select("__split_group"), "__split_group", "left_semi")
    if config.maximum_rows_per_file:
        out = numbered_within(out, "__placed", order, "__split_group")
        out = out.withColumn("__chunk", F.ceil(F.col("__placed") / config.maximum_rows_per_file).cast("long"))
    else:
        out = out.withColumn("__chunk", F.lit(1).cast("long"))
    return out.select(*df.columns, "__split_key", "__split_group", "__chunk")


def clean_name(text: str, limit: int = 180) -> str:
    """A text as part of a file name: unsafe characters and double dots become underscores, reserved names get one before."""
    name = re.sub(r'[<>:"/\\|?*\x00-\x1f]+', "_", text).replace("..", "_").strip(" ._") or "output"
    name = f"_{name}" if name.lower() in RESERVED else name
    return name[:limit].rstrip(" ._") or "output"


def safe_name(template: str, values: dict[str, str], taken: set[str], limit: int = 180) -> str:
    """A file name without an ending: values are cleaned before they are put in and the whole after, unknown variables are
    empty, a name that is taken gets a number."""
    filled = re.sub(r"\{(\w+)\}", lambda m: clean_name(str(values[m[1]])) if values.get(m[1]) else "", template)
    name = clean_name(filled, limit)
    out, n = name, 2
    while out.lower() in taken:
        out, n = f"{name[: limit - len(str(n)) - 1]}_{n}", n + 1
    taken.add(out.lower())
    return out


def summary(split: DataFrame) -> DataFrame:
    """Rows per output of a split: the driver reads only this."""
    return split.groupBy("__split_group", "__split_key", "__chunk").agg(F.count("*").alias("rows"))
