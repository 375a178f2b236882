"""Mapping source columns onto canonical fields, and aligning several sources to one schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.operators.cleaning import ROW_ID, slug
from prepweave.tables import in_ranges

TYPES = {"text": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


@dataclass(frozen=True)
class Field:
    id: str
    label: str = ""
    data_type: str = "text"
    required: bool = False
    nullable: bool = True
    unique: bool = False
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mapping:
    canonical_field_id: str
    source_column: str | None = None
    confidence: float = 1.0
    user_confirmed: bool = False
    constant_value: str | None = None
    default_value: str | None = None

    def __post_init__(self):
        if self.source_column is None and self.constant_value is None and self.default_value is None:
            raise PlanError("MAPPING_SOURCE_REQUIRED", self.canonical_field_id)


@dataclass(frozen=True)
class MappingSet:
    fields: tuple[Field, ...]
    mappings: tuple[Mapping, ...]
    version: int = 1

    def __post_init__(self):
        ids = [f.id for f in self.fields]
        targets = [m.canonical_field_id for m in self.mappings]
        if len(set(ids)) != len(ids) or len(set(targets)) != len(targets):
            raise PlanError("MAPPING_TARGET_DUPLICATE")
        if bad := [f for f in ids if slug(f) != f or not f[0].isalpha()]:
            raise PlanError("MAPPING_FIELD_ID_INVALID", ", ".join(bad))
        if unknown := set(targets) - set(ids):
            raise PlanError("MAPPING_TARGET_UNKNOWN", ", ".join(sorted(unknown)))

    def field(self, field_id: str) -> Field:
        return next(f for f in self.fields if f.id == field_id)


def resolve(mapping: Mapping, target: Field, columns: list[str]) -> str | None:
    """The source column: that of the mapping, else the first of the field's label and aliases that is there."""
    names = [mapping.source_column] if mapping.source_column else []
    return next((c for c in [*names, *[n for n in (target.label, *target.aliases) if n and mapping.constant_value is None]] if c in columns), None)


def with_row_ids(df: DataFrame, order: list) -> DataFrame:
    """Numbers rows from 1 in the order of the fields, which must be a key for the numbers to be stable.

    Rows are sorted by range over all tasks and numbered from the sizes of the ranges, which alone meet on the driver.
    """
    if ROW_ID in df.columns:
        return df
    spark = df.sparkSession
    placed = in_ranges(df, *order).withColumn("__in", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row a range
    bases, total = [], 0
    for p in sorted(counts):
        bases.append((p, total))
        total += counts[p]
    starts = spark.createDataFrame(bases or [(0, 0)], "__part long, __base long")
    return placed.join(F.broadcast(starts), "__part").withColumn(ROW_ID, F.col("__base") + F.col("__in") + 1).drop("__at", "__part", "__in", "__base")


def apply_mapping(df: DataFrame, mapping_set: MappingSet) -> DataFrame:
    """The canonical fields as text, with the row number that the source gave (column __row_id) kept.

    A default stands for null and empty values and for a column that is not there; a field without any of these is an
    error if required, else null. A constant gives a value on each row.
    """
    made: list[Column] = []
    by_target = {m.canonical_field_id: m for m in mapping_set.mappings}
    for f in mapping_set.fields:
        m = by_target.get(f.id)
        if m is None:
            continue
        if m.constant_value is not None:
            made.append(F.lit(m.constant_value).alias(f.id))
            continue
        source = resolve(m, f, df.columns)
        if source is None and m.default_value is None and f.required:
            raise PlanError("MAPPING_SOURCE_NOT_FOUND", f.id)
        c = F.col(f"`{source}`").cast("string") if source else F.lit(None).cast("string")
        if m.default_value is not None:
            c = F.when(c.isNull() | (c == ""), F.lit(m.default_value)).otherwise(c)
        made.append(c.alias(f.id))
    return df.select(*[F.col(c) for c in (ROW_ID,) if c in df.columns], *made)


def compatible(observed: str, wanted: str) -> bool:
    return observed == wanted or wanted == "text" or {observed, wanted} in ({"integer", "decimal"}, {"date", "datetime"})


@dataclass(frozen=True)
class AlignedSource:
    source_id: str
    mapping: MappingSet
    table_id: str = ""
    user_decisions: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class AlignmentPlan:
    canonical_fields: tuple[Field, ...]
    sources: tuple[AlignedSource, ...]
    required_missing_policy: str = "block_batch"
    extra_field_policy: str = "ignore"


def alignment_matrix(observed: dict[str, dict[str, str]], plan: AlignmentPlan) -> list[dict]:
    """A row per source and field: its status and what follows. observed gives each source's columns and their types."""
    cells: list[dict] = []
    for source in plan.sources:
        columns = observed.get(source.source_id, {})
        by_target = {m.canonical_field_id: m for m in source.mapping.mappings}
        used = set()
        for f in plan.canonical_fields:
            m = by_target.get(f.id)
            found = resolve(m, f, list(columns)) if m else next((c for c in (f.label, *f.aliases) if c in columns), None)
            action = "accept"
            if m and m.constant_value is not None:
                status = "constant"
            elif found:
                used.add(found)
                status = "mapped" if compatible(columns[found], f.data_type) else "type_mismatch"
                if status == "type_mismatch" and source.user_decisions.get(f.id) != "accept":
                    action = "block"
            elif m and m.default_value is not None:
                status = "defaulted"
            else:
                status = "missing_required" if f.required else "missing_optional"
                if f.required:
                    action = {"reject_file": "reject_file", "quarantine_file": "quarantine_file"}.get(plan.required_missing_policy, "block")
            cells.append({"source_id": source.source_id, "field_id": f.id, "status": status, "source_column": found, "action": action})
        for c in columns:
            if c not in used:
                action = {"include": "include", "block": "block"}.get(plan.extra_field_policy, "ignore")
                cells.append({"source_id": source.source_id, "field_id": c, "status": "extra", "source_column": c, "action": action})
    return cells


def eligible_sources(cells: list[dict]) -> list[str]:
    """Sources that take part; a blocking cell ends the plan."""
    if blocked := [f"{c['source_id']}.{c['field_id']}" for c in cells if c["action"] == "block"]:
        raise PlanError("SCHEMA_ALIGNMENT_BLOCKED", ", ".join(blocked))
    out = {c["source_id"] for c in cells if c["action"] in ("reject_file", "quarantine_file")}
    return [s for s in dict.fromkeys(c["source_id"] for c in cells) if s not in out]


def cast_field(c: Column, data_type: str) -> Column:
    """A text in the canonical type, null if it is no such value. yes and no are booleans, thousands may have commas."""
    s = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    if data_type in ("integer", "decimal"):
        plain = F.when(s.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
        return plain.try_cast(TYPES[data_type])
    if data_type == "boolean":
        return F.when(F.lower(s).isin("true", "yes", "1"), True).when(F.lower(s).isin("false", "no", "0"), False)
    if data_type in ("date", "datetime"):
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast(TYPES[data_type]))
    return c.cast("string")


def align_table(df: DataFrame, source: AlignedSource, filename: str, plan: AlignmentPlan) -> DataFrame:
    """One source in canonical types with its lineage: __source_row, __source_id, __source_file, __source_table."""
    mapped = apply_mapping(df, replace(source.mapping)) if not _extras(df, source, plan) else _with_extras(df, source, plan)
    fields = [(cast_field(F.col(f.id), f.data_type) if f.id in mapped.columns else F.lit(None).cast(TYPES[f.data_type])).alias(f.id) for f in plan.canonical_fields]
    known = {f.id for f in plan.canonical_fields} | {ROW_ID}
    extras = [F.col(c) for c in mapped.columns if c not in known]
    row = F.col(ROW_ID) if ROW_ID in mapped.columns else F.lit(None).cast("long")
    lineage = [row.alias("__source_row"), F.lit(source.source_id).alias("__source_id"), F.lit(filename).alias("__source_file"), F.lit(source.table_id).alias("__source_table")]
    return mapped.select(*fields, *extras, *lineage)


def _extras(df: DataFrame, source: AlignedSource, plan: AlignmentPlan) -> dict[str, str]:
    """Columns that no field uses, under ids of their own, if the plan includes them."""
    if plan.extra_field_policy != "include":
        return {}
    used = {resolve(m, source.mapping.field(m.canonical_field_id), df.columns) for m in source.mapping.mappings} | {ROW_ID}
    taken, out = {f.id for f in plan.canonical_fields}, {}
    for c in df.columns:
        if c in used:
            continue
        base, n = slug(c), 2
        name = base
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        out[c] = name
    return out


def _with_extras(df: DataFrame, source: AlignedSource, plan: AlignmentPlan) -> DataFrame:
    extras = _extras(df, source, plan)
    ids = tuple(Field(n) for n in extras.values())
    more = tuple(Mapping(n, source_column=c) for c, n in extras.items())
    return apply_mapping(df, MappingSet((*source.mapping.fields, *ids), (*source.mapping.mappings, *more)))
