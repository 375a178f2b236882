"""Exact order statistics of groups of any size, by distributed selection.

A percentile's own aggregate holds all different values of a group in one buffer. Here only groups of at most `buffer` rows go
that way. For larger ones each round draws up to a hundredfold narrower bounds around the wanted rank from mergeable
sketches, and counts exactly what lies below and within them; rows are only read, and sketches and counts are shuffled.
When few enough lie within, their different values are counted and the rank picked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.errors import PlanError
from prepweave.tables import running_total, written

#: Percentages of a sketch, its accuracy, and rounds after which what is left is sorted by range instead.
GRID, ACCURACY, ROUNDS = 200, 10_000, 8


def _same(names: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{n}`").eqNullSafe(F.col(f"{b}.`{n}`")) for n in names], F.lit(True))


def exact_percentiles(df: DataFrame, groups: list[str], column: str, fractions: list[float], buffer: int = 100_000, counts: DataFrame | None = None) -> DataFrame:
    """Per group the exact percentiles of a column as doubles p0, p1, ... for the fractions, interpolated between the two
    rows next to the place (a median of an even number of rows is the mean of the middle ones).

    Nulls do not count; a group without values has null. Null groups are groups. Groups of up to `buffer` values are
    left to Spark's aggregate, larger ones are selected by rounds. counts may give the groups with their number of values
    as `n`, if it is known and written.
    """
    if not groups or not fractions or any(not 0 <= p <= 1 for p in fractions):
        raise PlanError("PERCENTILE_INVALID", str(fractions))
    if missing := [c for c in (*groups, column) if c not in df.columns]:
        raise PlanError("AGGREGATION_FIELDS_NOT_FOUND", ", ".join(missing))
    names = [f"__g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)], F.col(f"`{column}`").alias("__v"))
    if counts is None:
        counts = written(rows.groupBy(*names).agg(F.count("__v").alias("n")), "counts")
    else:
        counts = counts.select(*[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)], "n")
    direct = lambda some: some.groupBy(*names).agg(F.percentile(F.col("__v").cast("double"), F.array(*map(F.lit, fractions))).alias("__p"))
    most = counts.agg(F.max("n")).first()[0] or 0
    if most <= buffer:
        out = direct(rows)
    else:
        large = counts.filter(F.col("n") > buffer)
        few = rows.alias("a").join(large.alias("b"), _same(names, "a", "b"), "left_anti")
        out = direct(few).unionByName(_selected(rows.filter("__v IS NOT NULL"), large, names, fractions, buffer))
    return out.select(*[F.col(n).alias(g) for n, g in zip(names, groups)], *[F.try_element_at("__p", F.lit(i + 1)).alias(f"p{i}") for i in range(len(fractions))])


def _selected(rows: DataFrame, large: DataFrame, names: list[str], fractions: list[float], buffer: int) -> DataFrame:
    """The percentiles of groups of more than `buffer` values. A target is a fraction of a group: the ranks of its two rows,
    the bounds that hold them, and how many values lie below and within."""
    kind = rows.schema["__v"].dataType
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.lit(float(p)).alias("p")) for i, p in enumerate(fractions)]))
    targets = large.withColumn("__w", wanted).select(*names, "n", "__w.of", "__w.p")
    place = F.col("p") * (F.col("n") - 1)
    targets = targets.select(*names, "of", (place - F.floor(place)).alias("part"), F.floor(place).alias("first"), F.ceil(place).alias("last"), F.lit(None).cast(kind).alias("lo"), F.lit(None).cast(kind).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("within"), F.lit(False).alias("one"))
    targets = written(targets, "targets")
    grid = [i / GRID for i in range(1, GRID)]
    inside = (F.col("lo").isNull() | (F.col("__v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("__v") <= F.col("hi")))
    met = lambda open_: rows.alias("a").join(F.broadcast(open_.alias("b")) if few else open_.alias("b"), _same(names, "a", "b")).drop(*[F.col(f"a.`{n}`") for n in names])
    few = targets.count() <= 100_000  # a target is some hundred bytes; there is one for `buffer` rows at most
    for _ in range(ROUNDS):
        open_ = targets.filter((F.col("within") > buffer) & ~F.col("one"))
        if open_.isEmpty():
            break
        keep = [*names, "of", "part", "first", "last", "lo", "hi", "below", "within"]
        sketch = met(open_).filter(inside).groupBy(*keep).agg(F.approx_percentile("__v", F.array(*map(F.lit, grid)), ACCURACY).alias("__q"))
        low = F.floor((F.col("first") - F.col("below")) / F.col("within") * GRID).cast("int") - 1
        high = F.ceil((F.col("last") - F.col("below") + 1) / F.col("within") * GRID).cast("int") + 1
        sketch = sketch.withColumn("lo", F.when(low >= 1, F.try_element_at("__q", F.greatest(low, F.lit(1)))).otherwise(F.col("lo")))
        sketch = sketch.withColumn("hi", F.when(high <= GRID - 1, F.try_element_at("__q", F.least(F.greatest(high, F.lit(1)), F.lit(GRID - 1)))).otherwise(F.col("hi")))
        bounds = written(sketch.drop("__q", "below", "within"), "bounds")
        counted = met(bounds).groupBy(*names, "of", "part", "first", "last", "lo", "hi").agg(
            F.count_if(F.col("__v") < F.col("lo")).alias("below"), F.count_if(inside).alias("within"), (F.min(F.when(inside, F.col("__v"))) == F.max(F.when(inside, F.col("__v")))).alias("one")
        )
        holds = (F.col("below") <= F.col("first")) & (F.col("last") < F.col("below") + F.col("within"))  # sketches err by far less than a step
        if not (bad := counted.filter(~holds)).isEmpty():
            raise PlanError("PERCENTILE_BOUNDS", str(bad.count()))
        targets = written(targets.filter(~((F.col("within") > buffer) & ~F.col("one"))).unionByName(counted.select(targets.columns)), "targets")
    found = met(targets).filter(inside)
    ids = [*names, "of", "part", "first", "last", "below", "within", "one"]
    values = written(found.groupBy(*ids, "__v").agg(F.count("*").alias("__n")), "values")
    if targets.filter((F.col("within") > buffer) & ~F.col("one")).isEmpty():
        until = values.withColumn("__to", F.sum("__n").over(W.partitionBy(*names, "of").orderBy("__v")))  # at most `buffer` values
    else:
        values = values.withColumn("__id", F.to_json(F.struct(*names, "of")))
        until = running_total(values, F.col("__n"), "__to", ["__v"], "__id")
    until = until.withColumn("__to", F.col("__to") + F.col("below")).withColumn("__from", F.col("__to") - F.col("__n"))
    at = lambda rank: F.max(F.when((F.col("__from") <= F.col(rank)) & (F.col(rank) < F.col("__to")), F.col("__v").cast("double")))
    picked = until.groupBy(*names, "of", "part").agg(at("first").alias("__a"), at("last").alias("__b"))
    # between equal values nothing is computed, so that an infinite one stays
    value = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") * (1 - F.col("part")) + F.col("__b") * F.col("part"))
    return picked.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("of", value.alias("v")))), lambda x: x["v"]).alias("__p"))
