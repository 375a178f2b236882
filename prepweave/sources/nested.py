"""Nested records as related tables: JSON lines as VARIANT values, their schema merged over all rows, a table for each list."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepweave.operators.mapping import with_row_ids
from prepweave.tables import written

ROW, PARENT, PLACE = "__row_id", "__parent_id", "__position"


@dataclass
class Nested:
    """tables by the path of their list ("" for the records); malformed lines with their number."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    malformed: DataFrame | None = None
    schema: str = ""


def merged_schema(values: DataFrame, column: str = "value") -> T.DataType:
    """The schema that holds all rows' values: objects are united, numbers widened, what can't be is left as VARIANT."""
    text = values.agg(F.schema_of_variant_agg(column)).first()[0] or "VOID"
    return T._parse_datatype_string(text.replace("OBJECT<", "STRUCT<"))


def _cells(value: Column, kind: T.StructType, before: str, path: str) -> tuple[list[tuple[str, Column]], list[tuple[str, Column, T.DataType]]]:
    """The scalar cells below an object, objects in it flattened to dotted names, and the lists in it."""
    cells, lists = [], []
    for f in kind.fields:
        name, mark = f"{before}{f.name}", "'" if "'" not in f.name else '"'
        here, at = value, f"{path}[{mark}{f.name}{mark}]"
        if mark in f.name:  # no path can name it
            here, at = F.try_element_at(F.try_variant_get(value, path, "map<string,variant>"), F.lit(f.name)), "$"
        if isinstance(f.dataType, T.StructType):
            inner, more = _cells(here, f.dataType, f"{name}.", at)
            cells += inner
            lists += more
        elif isinstance(f.dataType, T.ArrayType):
            lists.append((name, F.try_variant_get(here, at, "array<variant>"), f.dataType.elementType))
        else:
            cells.append((name, F.try_variant_get(here, at, _kind(f.dataType))))
    return cells, lists


def _kind(kind: T.DataType) -> str:
    return "string" if isinstance(kind, T.NullType) else kind.simpleString()


def read_nested(spark: SparkSession, lines: DataFrame, order: list[str], column: str = "value") -> Nested:
    """The records of JSON lines as tables.

    Each has __row_id from 1; a table below another also has __parent_id, its record's __row_id, and __position in its list,
    from 0. Scalars are columns of the type that fits all rows, objects' fields dotted columns, a list of scalars a table
    with column `value`; a cell that is absent, null or of a shape of its own is null. Records that are no object have
    their value in column `value`. Lines that are no JSON are malformed, blank ones left out.
    """
    numbered = with_row_ids(lines.filter(F.trim(F.col(column)) != "").select(*order, F.col(column).alias("__line")), order)
    parsed = written(numbered.select(ROW, "__line", F.try_parse_json("__line").alias("value")), "variants")
    out = Nested(malformed=parsed.filter("value IS NULL").select(ROW, F.col("__line").alias("line")))
    values = parsed.filter("value IS NOT NULL").select(ROW, "value")
    kind = merged_schema(values)
    out.schema = kind.simpleString()
    _add(out, "", values, kind)
    return out


def _add(out: Nested, path: str, values: DataFrame, kind: T.DataType) -> None:
    ids = [c for c in values.columns if c != "value"]
    v = F.col("value")
    if not isinstance(kind, T.StructType):
        if isinstance(kind, T.ArrayType):
            out.tables[path] = values.select(*ids)
            _below(out, path, values, "", F.try_variant_get(v, "$", "array<variant>"), kind.elementType)
        else:
            out.tables[path] = values.select(*ids, F.try_variant_get(v, "$", _kind(kind)).alias("value"))
        return
    cells, lists = _cells(v, kind, "", "$")
    out.tables[path] = values.select(*ids, *[c.alias(n) for n, c in cells])
    for name, elements, element in lists:
        _below(out, path, values, name, elements, element)


def _below(out: Nested, path: str, values: DataFrame, name: str, elements: Column, element: T.DataType) -> None:
    """The table of a list: its elements, numbered by parent and place."""
    listed = values.select(F.col(ROW).alias(PARENT), F.posexplode(elements).alias(PLACE, "value"))
    below = f"{path}.{name}" if path and name else path + name or "items"
    rows = written(with_row_ids(listed, [PARENT, PLACE]).select(ROW, PARENT, PLACE, "value"), "elements")
    _add(out, below, rows, element)


def folded(parent: DataFrame, child: DataFrame, name: str) -> DataFrame:
    """The parents with their children as a list of structs in the order of __position; an empty list without any."""
    cells = [c for c in child.columns if c not in (ROW, PARENT, PLACE)]
    each = child.groupBy(F.col(PARENT).alias("__of")).agg(F.sort_array(F.collect_list(F.struct(PLACE, F.struct(*[F.col(f"`{c}`").alias(c) for c in cells]).alias("x")))).alias("__all"))
    empty = F.array().cast(T.ArrayType(T.StructType([child.schema[c] for c in cells])))
    joined = parent.join(each, F.col(ROW) == F.col("__of"), "left")
    return joined.withColumn(name, F.coalesce(F.col("__all.x"), empty)).drop("__of", "__all")
