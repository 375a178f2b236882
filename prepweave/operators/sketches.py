"""Sketches of groups that are stored as columns and merged batch by batch: different values, quantiles, heavy hitters.

Each sketch is a map whose merge is a maximum or a sum of its entries, so that the sketches of batches, merged in any order
and any number of times, equal the sketch of all rows at once. Tasks combine entries before the shuffle; a sketch has a
bounded number of them, whatever the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.errors import PlanError
from prepweave.tables import written

#: Registers of a sketch of different values; the standard error of its estimate is 1.04 / sqrt(REGISTERS), 1.6 %.
REGISTERS = 4096
#: A quantile lies within this share of its value.
RELATIVE = 0.01
GAMMA = (1 + RELATIVE) / (1 - RELATIVE)
OFFSET = 1 << 20
#: Cells of a row of counters, and rows: a count is too high by more than n * 2.72 / CELLS once in exp(ROWS) items.
CELLS, ROWS = 2719, 4


def _names(df: DataFrame, groups: list[str], *columns: str) -> list[Column]:
    if missing := [c for c in (*groups, *columns) if c not in df.columns]:
        raise PlanError("SKETCH_FIELDS_NOT_FOUND", ", ".join(missing))
    return [F.col(f"`{g}`") for g in groups]


def _as_map(entries: DataFrame, groups: list[str], merge) -> DataFrame:
    """Entries (groups, k, v) combined and put together to a map for each group; one map at most without groups."""
    each = entries.groupBy(*[F.col(f"`{g}`") for g in groups], "k").agg(merge("v").alias("v"))
    return each.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("sketch"))


def _entries(sketched: DataFrame, groups: list[str]) -> DataFrame:
    return sketched.select(*_names(sketched, groups, "sketch"), F.explode("sketch").alias("k", "v"))


def distinct_sketch(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """Per group `sketch`, a map from register to rank of the column's different values (HyperLogLog). Nulls do not count;
    a group of nulls has no row."""
    digest = F.md5(F.col(f"`{column}`").cast("string"))
    register = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    rank = 53 - F.length(F.bin(F.conv(F.substring(digest, 4, 13), 16, 10).cast("long")))
    rows = df.filter(F.col(f"`{column}`").isNotNull()).select(*_names(df, groups, column), register.alias("k"), rank.alias("v"))
    return _as_map(rows, groups, F.max)


def merge_distinct(sketched: DataFrame, groups: list[str]) -> DataFrame:
    return _as_map(_entries(sketched, groups), groups, F.max)


def distinct_estimate(sketch: Column) -> Column:
    """The number of different values, with linear counting while registers are empty."""
    empty = REGISTERS - F.size(sketch)
    z = F.aggregate(F.map_values(sketch), empty.cast("double"), lambda acc, r: acc + F.pow(F.lit(2.0), -r))
    raw = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS * REGISTERS / z
    return F.when((raw <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * F.log(REGISTERS / empty)).otherwise(raw)


def quantile_sketch(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """Per group `sketch`, a map from a value's bucket to the number of rows; buckets grow by GAMMA. Nulls and values that
    are not finite do not count."""
    v = F.col(f"`{column}`").cast("double")
    size = F.ceil(F.log(F.abs(v)) / F.log(F.lit(GAMMA))) + OFFSET
    bucket = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.filter(fine).select(*_names(df, groups, column), bucket.alias("k"), F.lit(1).cast("long").alias("v"))
    return _as_map(rows, groups, F.sum)


def merge_quantiles(sketched: DataFrame, groups: list[str]) -> DataFrame:
    return _as_map(_entries(sketched, groups), groups, F.sum)


def quantile_estimates(sketched: DataFrame, groups: list[str], fractions: list[float]) -> DataFrame:
    """Per group q0, q1, ...: a value within RELATIVE of that of the row at floor(fraction * (n - 1)). A group's buckets, some
    thousand at most, are one window."""
    by = [F.col(f"`{g}`") for g in groups]
    each = _entries(sketched, groups)
    each = each.withColumn("to", F.sum("v").over(W.partitionBy(*by).orderBy("k"))).withColumn("n", F.sum("v").over(W.partitionBy(*by)))
    middle = F.when(F.col("k") == 0, 0.0).otherwise(F.signum("k") * 2 * F.pow(F.lit(GAMMA), F.abs("k") - OFFSET) / (GAMMA + 1))
    at = lambda p: F.min_by(middle, F.when(F.col("to") > F.floor(F.lit(float(p)) * (F.col("n") - 1)), F.col("k")))
    return each.groupBy(*by).agg(*[at(p).alias(f"q{i}") for i, p in enumerate(fractions)])


def _cells(item: Column) -> list[Column]:
    digest = F.md5(item)
    return [(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % CELLS + i * CELLS).cast("int") for i in range(ROWS)]


def frequency_sketch(df: DataFrame, groups: list[str], column: str, share: float = 0.01) -> DataFrame:
    """Per group `sketch` (counters of hashed values), n, and `heavy`: values that the counters give at least share * n.

    The rows are read twice: for the counters, then to look each value up in them, so that only heavy values are shuffled.
    Nulls do not count.
    """
    known = df.filter(F.col(f"`{column}`").isNotNull()).select(*[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)], F.col(f"`{column}`").cast("string").alias("__v"))
    _names(df, groups, column)
    names = [f"__g{i}" for i in range(len(groups))]
    counters = _as_map(known.select(*names, F.explode(F.array(*_cells(F.col("__v")))).alias("k"), F.lit(1).cast("long").alias("v")), names, F.sum)
    counters = written(counters.withColumn("n", _total(F.col("sketch"))), "counters")
    return _with_heavy(known, counters, names, groups, share)


def _total(sketch: Column) -> Column:
    """The rows behind a sketch: the sum of its first row of counters."""
    return F.aggregate(F.map_values(F.map_filter(sketch, lambda k, v: k < CELLS)), F.lit(0).cast("long"), lambda a, v: a + v)


def _with_heavy(known: DataFrame, counters: DataFrame, names: list[str], groups: list[str], share: float) -> DataFrame:
    """Adds the values of `known` whose estimate reaches the share."""
    cells = _entries(counters, names).select(*[F.col(n).alias(f"{n}_") for n in names], "k", "v")
    cells = F.broadcast(cells) if cells.count() <= 1_000_000 else cells  # CELLS * ROWS a group
    one = known.distinct().withColumn("k", F.explode(F.array(*_cells(F.col("__v")))))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], one["k"] == cells["k"])
    found = one.join(cells, same).groupBy(*names, "__v").agg(F.min("v").alias("about"))
    both = reduce(lambda a, b: a & b, [found[n].eqNullSafe(F.col(f"{n}_")) for n in names], F.lit(True))
    totals = counters.select(*[F.col(n).alias(f"{n}_") for n in names], "n")
    heavy = found.join(F.broadcast(totals), both).filter(F.col("about") >= share * F.col("n")).groupBy(*names).agg(F.sort_array(F.collect_list("__v")).alias("heavy"))
    heavy = heavy.select(*[F.col(n).alias(f"{n}_") for n in names], "heavy")
    match = reduce(lambda a, b: a & b, [counters[n].eqNullSafe(F.col(f"{n}_")) for n in names], F.lit(True))
    out = counters.join(heavy, match, "left")
    return out.select(*[F.col(n).alias(g) for n, g in zip(names, groups)], "sketch", "n", F.coalesce("heavy", F.array().cast("array<string>")).alias("heavy"))


def merge_frequencies(sketched: DataFrame, groups: list[str], share: float = 0.01) -> DataFrame:
    """Counters add up. A value that has the share of all rows has it in one of the batches, so the heavy values of all are
    among those of the batches."""
    names = [f"__g{i}" for i in range(len(groups))]
    mine = sketched.select(*[c.alias(n) for c, n in zip(_names(sketched, groups, "sketch", "heavy"), names)], "sketch", "heavy")
    counters = _as_map(_entries(mine, names), names, F.sum)
    counters = written(counters.withColumn("n", _total(F.col("sketch"))), "counters")
    return _with_heavy(mine.select(*names, F.explode("heavy").alias("__v")), counters, names, groups, share)


def heavy_hitters(sketched: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of heavy values: groups, value, about (never below the value's count), n."""
    each = sketched.select(*_names(sketched, groups, "heavy"), "sketch", "n", F.explode("heavy").alias("value"))
    return each.select(*[F.col(f"`{g}`") for g in groups], "value", F.array_min(F.array(*[F.try_element_at("sketch", c) for c in _cells(F.col("value"))])).alias("about"), "n")
