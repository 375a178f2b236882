"""Cubes, rollups and grouping sets from their finest level, without a copy of each row for each set.

Rows are grouped once, by all keys, to mergeable states (counts, sums, extremes, and the different values of what is
counted distinctly). Coarser sets are made from these groups; where there are many, each from the smallest finer set that
is there already. So what is shuffled of the rows does not grow with the number of sets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepweave.errors import PlanError
from prepweave.operators.aggregate import Measure
from prepweave.tables import written

FUNCTIONS = ("sum", "count", "average", "minimum", "maximum", "unique_count")
#: Groups of the finest level from which all sets are made directly; of more, sets are chained.
MANY = 1_000_000


def cube(keys: list[str]) -> list[list[str]]:
    return [list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def rollup(keys: list[str]) -> list[list[str]]:
    return [keys[:n] for n in range(len(keys), -1, -1)]


def grouping_sets(df: DataFrame, sets: list[list[str]], measures: list[Measure], many: int = MANY) -> DataFrame:
    """A row for each group of each set: all keys (null where the set has it not), grouping_id (a bit for each key, the first
    highest, set where the key is not grouped by) and the measures.

    Null keys are groups of their own, told apart by grouping_id. A sum of nulls is 0, a null counts as one different
    value, as in aggregate_table(); medians, first and last can't be merged and are errors. The empty set gives a row
    also of an empty table. A set that stands twice is given once.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    if not sets or not measures or any(m.function not in FUNCTIONS for m in measures):
        raise PlanError("GROUPING_SETS_INVALID", ", ".join(m.function for m in measures))
    if missing := [c for c in (*keys, *[m.field_id for m in measures]) if c not in df.columns]:
        raise PlanError("AGGREGATION_FIELDS_NOT_FOUND", ", ".join(missing))
    for m in measures:
        if m.function in ("sum", "average") and not isinstance(df.schema[m.field_id].dataType, T.NumericType):
            raise PlanError("AGGREGATION_TYPE_INVALID", m.field_id)
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    fields = list(dict.fromkeys(m.field_id for m in measures))
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], *[F.col(f"`{f}`").alias(f"__v{i}") for i, f in enumerate(fields)])
    used = {(m.function, fields.index(m.field_id)) for m in measures}
    states: dict[str, tuple] = {}  # of a name: how it is made of rows, how of states
    for function, i in sorted(used):
        v = F.col(f"__v{i}")
        if function in ("sum", "average"):
            states[f"__s{i}"] = F.sum(v), F.sum
        if function in ("count", "average"):
            states[f"__n{i}"] = F.count(v), F.sum
        if function in ("minimum", "maximum"):
            name, make = (f"__lo{i}", F.min) if function == "minimum" else (f"__hi{i}", F.max)
            states[name] = make(v), make
    states["__rows"] = F.count("*"), F.sum
    every = list(names.values())
    finest = written(rows.groupBy(*every).agg(*[c.alias(n) for n, (c, _) in states.items()]), "finest")
    kinds = {i: written(rows.select(*every, f"__v{i}").distinct(), "kinds") for f, i in used if f == "unique_count"}
    chained = finest.count() > many
    made: list[tuple[frozenset, DataFrame, int]] = [(frozenset(every), finest, 0)]
    out = None
    wanted = sorted({frozenset(names[k] for k in s) for s in sets}, key=lambda s: (-len(s), sorted(s)))
    for s in wanted:
        own = [k for k in every if k in s]
        source = min((m for m in made if s <= m[0]), key=lambda m: m[2])[1] if chained else finest
        level = source if s == frozenset(every) else source.groupBy(*own).agg(*[merge(n).alias(n) for n, (_, merge) in states.items()])
        if chained and s != frozenset(every):
            level = written(level, "level")
            made.append((s, level, level.count()))
        level = level.withColumn("__one", F.lit(1))  # a key also for the empty set
        for i, table in kinds.items():
            different = table.groupBy(*own).agg((F.count_distinct(f"__v{i}") + F.coalesce(F.max(F.col(f"__v{i}").isNull().cast("int")), F.lit(0))).alias(f"__d{i}"))
            different = different.select(*[F.col(k).alias(f"{k}_") for k in own], F.lit(1).alias("__one_"), f"__d{i}")
            same = F.col("__one") == F.col("__one_")
            for k in own:
                same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
            level = level.join(different, same, "left").drop("__one_", *[f"{k}_" for k in own])
        absent = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in every if k not in s]
        number = sum(1 << (len(every) - 1 - i) for i, k in enumerate(every) if k not in s)
        done = level.select(*own, *absent, F.lit(number).cast("long").alias("grouping_id"), *[_result(m.function, fields.index(m.field_id)).alias(m.output_field_id) for m in measures])
        out = done if out is None else out.unionByName(done)
    return out.select(*[F.col(n).alias(k) for k, n in names.items()], "grouping_id", *[F.col(f"`{m.output_field_id}`") for m in measures])


def _result(function: str, i: int) -> Column:
    return {
        "sum": lambda: F.coalesce(F.col(f"__s{i}"), F.lit(0)),
        "count": lambda: F.coalesce(F.col(f"__n{i}"), F.lit(0)),
        "average": lambda: F.try_divide(F.col(f"__s{i}"), F.col(f"__n{i}")),
        "minimum": lambda: F.col(f"__lo{i}"),
        "maximum": lambda: F.col(f"__hi{i}"),
        "unique_count": lambda: F.coalesce(F.col(f"__d{i}"), F.lit(0)),
    }[function]()
