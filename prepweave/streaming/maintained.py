"""Grouped aggregates that are kept up to date by inserted, changed and deleted rows.

Every state is a sum, so that a batch of changes is a delta: per group the signed count and sums, and for extremes and
distinct counts a multiset, the signed count of each value. A batch writes the delta of the groups it touches and nothing
else; reading adds up the deltas, and compact() folds them into one. A hot group is a partial sum in each task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepweave.errors import PlanError

SIGN = "__sign"
FUNCTIONS = ("count", "sum", "average", "minimum", "maximum", "unique_count")


@dataclass(frozen=True)
class Kept:
    """A measure: count of a field's values (of rows if the field is empty), or another function of it."""

    function: str
    field_id: str
    output_field_id: str


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What turns old into new: rows of old that are gone or different with sign -1, those of new with sign +1. Nulls are
    equal to each other; keys are unique and not null."""
    if sorted(old.columns) != sorted(new.columns):
        raise PlanError("CHANGES_FIELDS_DIFFER", ", ".join(sorted(set(old.columns) ^ set(new.columns))))
    names = old.columns
    a = old.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in names]).alias("__old"))
    b = new.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in names]).alias("__new"))
    both = a.join(b, [f"__k{i}" for i in range(len(keys))], "full").filter(~F.col("__old").eqNullSafe(F.col("__new")))
    signed = F.array(F.struct(F.col("__old").alias("row"), F.lit(-1).alias("sign")), F.struct(F.col("__new").alias("row"), F.lit(1).alias("sign")))
    each = both.select(F.explode(signed).alias("__x")).filter(F.col("__x.row").isNotNull())
    return each.select(*[F.col("__x.row")[c].alias(c) for c in names], F.col("__x.sign").alias(SIGN))


class Maintained:
    """An aggregate below a folder: sums/ and values/ with a folder for each batch. A batch that is applied again, after a
    failure or by mistake, replaces itself, as its folder has its number."""

    def __init__(self, spark: SparkSession, folder: str, group_fields: list[str], measures: list[Kept]):
        if not group_fields or not measures or any(m.function not in FUNCTIONS for m in measures):
            raise PlanError("MAINTAINED_INVALID", ", ".join(m.function for m in measures))
        self.spark, self.folder, self.groups, self.measures = spark, folder.rstrip("/"), list(group_fields), list(measures)
        self.fields = list(dict.fromkeys(m.field_id for m in measures if m.field_id))
        self.sets = list(dict.fromkeys(m.field_id for m in measures if m.function in ("minimum", "maximum", "unique_count")))

    def _names(self) -> list[Column]:
        return [F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(self.groups)]

    def apply(self, rows: DataFrame, batch: int) -> None:
        """Writes the delta of a batch of rows with __sign, +1 for rows that come and -1 for rows that go."""
        missing = [c for c in (*self.groups, *self.fields, SIGN) if c not in rows.columns]
        if missing:
            raise PlanError("MAINTAINED_FIELDS_NOT_FOUND", ", ".join(missing))
        sign = F.col(SIGN).cast("long")
        sums = [F.sum(sign).alias("n")]
        for i, f in enumerate(self.fields):
            c = F.col(f"`{f}`")
            sums.append(F.sum(F.when(c.isNotNull(), sign).otherwise(0)).alias(f"n{i}"))
            if isinstance(rows.schema[f].dataType, T.NumericType):
                kind = rows.schema[f].dataType
                exact = c.cast("decimal(38,6)") if isinstance(kind, T.FractionalType) else c.cast("decimal(38,0)")  # sums of doubles would not cancel
                sums.append(F.sum(exact * sign.cast("int")).cast("decimal(38,6)").alias(f"s{i}"))
        names = [f"g{i}" for i in range(len(self.groups))]
        delta = rows.groupBy(*self._names()).agg(*sums)
        delta.filter(" OR ".join(f"{c} <> 0" for c in delta.columns if c not in names)).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={batch}")
        for i, f in enumerate(self.sets):
            counted = rows.filter(F.col(f"`{f}`").isNotNull()).groupBy(*self._names(), F.col(f"`{f}`").alias("value")).agg(F.sum(sign).alias("n")).filter("n <> 0")
            counted.write.mode("overwrite").parquet(f"{self.folder}/values{i}/batch={batch}")

    def _read(self, name: str, batch: int | None = None) -> DataFrame | None:
        try:
            path = f"{self.folder}/{name}"
            return self.spark.read.option("basePath", path).parquet(path if batch is None else f"{path}/batch={batch}")
        except AnalysisException:
            return None

    def touched(self, batch: int) -> DataFrame:
        """The groups that a batch has written."""
        return self._read("sums", batch).select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(self.groups)])

    def result(self) -> DataFrame:
        """The aggregate of all batches: a row for each group that has rows. A sum of no value is 0, other functions of
        none are null; averages and sums of fractions are exact to six places. An extreme is that of the values whose
        count is above 0."""
        state = self._read("sums")
        if state is None:
            raise PlanError("MAINTAINED_EMPTY", self.folder)
        names = [f"g{i}" for i in range(len(self.groups))]
        out = state.groupBy(*names).agg(*[F.sum(c).alias(c) for c in state.columns if c not in (*names, "batch")]).filter("n > 0")
        for i, f in enumerate(self.sets):
            values = self._read(f"values{i}").groupBy(*names, "value").agg(F.sum("n").alias("n")).filter("n > 0")
            held = values.groupBy(*[F.col(c).alias(f"__{c}") for c in names]).agg(F.min("value").alias(f"min{i}"), F.max("value").alias(f"max{i}"), F.count("*").alias(f"kinds{i}"))
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]
            out = out.join(held, same, "left").drop(*[f"__{c}" for c in names])
        made = {
            "count": lambda m: F.col(f"n{self.fields.index(m.field_id)}") if m.field_id else F.col("n"),
            "sum": lambda m: F.coalesce(F.col(f"s{self.fields.index(m.field_id)}"), F.lit(0)),
            "average": lambda m: F.try_divide(F.col(f"s{self.fields.index(m.field_id)}"), F.col(f"n{self.fields.index(m.field_id)}")),
            "minimum": lambda m: F.col(f"min{self.sets.index(m.field_id)}"),
            "maximum": lambda m: F.col(f"max{self.sets.index(m.field_id)}"),
            "unique_count": lambda m: F.coalesce(F.col(f"kinds{self.sets.index(m.field_id)}"), F.lit(0)),
        }
        return out.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(self.groups)], *[made[m.function](m).alias(m.output_field_id) for m in self.measures])

    def compact(self, into: str) -> Maintained:
        """The same aggregate with all batches folded into batch 0 of another folder; this one stays as it is."""
        other = Maintained(self.spark, into, self.groups, self.measures)
        names = [f"g{i}" for i in range(len(self.groups))]
        state = self._read("sums")
        state.groupBy(*names).agg(*[F.sum(c).cast(state.schema[c].dataType).alias(c) for c in state.columns if c not in (*names, "batch")]).filter("n <> 0").write.parquet(f"{other.folder}/sums/batch=0")
        for i, _ in enumerate(self.sets):
            self._read(f"values{i}").groupBy(*names, "value").agg(F.sum("n").alias("n")).filter("n <> 0").write.parquet(f"{other.folder}/values{i}/batch=0")
        return other
