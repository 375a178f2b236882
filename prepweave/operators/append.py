"""Appending tables by name, and what happens to rows that repeat."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepweave.errors import PlanError
from prepweave.operators.cleaning import need

#: Names that begin so are lineage and not data.
SEQ = "__seq"


@dataclass(frozen=True)
class AppendConfig:
    output_field_order: list[str] = field(default_factory=list)
    duplicate_policy: str = "keep_all"
    duplicate_key_fields: list[str] = field(default_factory=list)


@dataclass
class Result:
    """A composition's tables, all lazy; those that do not apply are None."""

    table: DataFrame
    rejected: DataFrame | None = None
    review: DataFrame | None = None
    left_unmatched: DataFrame | None = None
    right_unmatched: DataFrame | None = None
    duplicates: DataFrame | None = None
    diagnostics: DataFrame | None = None
    #: How many rows a keep policy drops, counted over the keys.
    surplus: DataFrame | None = None


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: text before all, doubles before integers, timestamps before dates, null below any."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    ladder = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    kinds = [next((i for i, k in enumerate(ladder) if isinstance(x, k)), None) for x in (a, b)]
    if None not in kinds:
        high = max(kinds)
        return ladder[5 if high == 4 and min(kinds) in (2, 3) else high]()
    if all(isinstance(x, (T.DecimalType, T.IntegralType)) for x in (a, b)):
        wide = [(x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (19, 0) for x in (a, b)]
        scale = max(w[1] for w in wide)
        return T.DecimalType(min(38, max(w[0] for w in wide) + scale), scale)
    if all(isinstance(x, (T.DecimalType, T.NumericType)) for x in (a, b)):
        return T.DoubleType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return T.TimestampType()
    return T.StringType()


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """All rows, duplicates too; a field that a table lacks is null there; types widen to what holds all."""
    kinds: dict[str, T.DataType] = {}
    for t in tables:
        for f in t.schema:
            kinds[f.name] = supertype(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    same = [t.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in t.columns]) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def _keys(df: DataFrame, fields: list[str]) -> list[str]:
    need(df, fields, "DUPLICATE_KEY_FIELDS_NOT_FOUND")
    return fields or [c for c in df.columns if not c.startswith("__")]


def append_tables(tables: list[DataFrame], config: AppendConfig = AppendConfig(), order: list[str] | None = None) -> Result:
    """The tables one below the other, then the duplicate policy.

    order names the fields that, after the table's place, order its rows; a keep policy needs them to be the same on
    each run. Policies: keep_all; remove_exact and keep_first (the first of equal keys), keep_last; reject and
    route_review (all rows of a repeated key leave the table, with a reason code). Equal keys include null keys.
    """
    if not tables:
        raise PlanError("APPEND_TABLES_REQUIRED")
    if config.duplicate_policy not in {"keep_all", "remove_exact", "keep_first", "keep_last", "reject", "route_review"}:
        raise PlanError("DUPLICATE_POLICY_UNSUPPORTED", config.duplicate_policy)
    placed = [t.withColumn("__place", F.lit(i)) for i, t in enumerate(tables)]
    out = union_by_name(placed)
    first = [f for f in config.output_field_order if f in out.columns]
    names = first + [c for c in out.columns if c not in first and c != "__place"]
    keys = _keys(out.drop("__place"), [] if config.duplicate_policy == "remove_exact" else config.duplicate_key_fields)
    many = out.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1")
    duplicates = many.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("duplicate_rows"))
    if config.duplicate_policy == "keep_all":
        return Result(out.select(*names), duplicates=duplicates)
    if config.duplicate_policy in ("reject", "route_review"):
        # repeated keys are counted before they meet the rows, so that a frequent key is not one task's window
        names_of = {f"__key_{i}": F.col(f"`{k}`") for i, k in enumerate(keys)}
        repeated = out.groupBy(*[c.alias(n) for n, c in names_of.items()]).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
        same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(n)) for n, c in names_of.items()])
        code = "DUPLICATE_ROW_REJECTED" if config.duplicate_policy == "reject" else "DUPLICATE_ROW_REVIEW"
        aside = out.join(repeated, same, "left_semi").select(*names, F.lit(code).alias("__reason_codes"))
        kept = out.join(repeated, same, "left_anti").select(*names)
        return Result(kept, **{"rejected" if config.duplicate_policy == "reject" else "review": aside}, duplicates=duplicates)
    rest = order or sorted(c for c in names if c not in keys)
    best = F.max_by if config.duplicate_policy == "keep_last" else F.min_by
    # combined before the shuffle, so a frequent key sends a row from each task
    kept = out.groupBy(*[F.col(f"`{k}`").alias(f"__key_{i}") for i, k in enumerate(keys)]).agg(best(F.struct(*[F.col(f"`{c}`") for c in names]), F.struct("__place", *[F.col(f"`{c}`") for c in rest])).alias("__row"))
    return Result(kept.select(*[F.col("__row")[c].alias(c) for c in names]), duplicates=duplicates, surplus=many.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("surplus_rows")))
