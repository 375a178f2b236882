"""Operations that need the order of a whole table, or of a hot key: as-of joins, fills, shifts, ranks and frames.

Rows are sorted by range over all tasks and written once (tables.in_ranges). Each range is worked on by itself; what it
needs of other ranges is one row a range (the last value before it) or the few rows next to its edges. So no window holds
the whole table, and a key with half of all rows is as many tasks as it has ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.errors import PlanError
from prepweave.tables import in_ranges, running_total, written


def inside() -> W:
    """The rows of a range in order."""
    return W.partitionBy("__part").orderBy("__at")


def inside_back() -> W:
    """The rows of a range from the last on: a frame that ends at the last row is read anew by Spark for each of its rows,
    while one that begins there grows."""
    return W.partitionBy("__part").orderBy(F.desc("__at"))


def _same(columns: list[str], struct: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(struct[c]) for c in columns], F.lit(True))


def carried(rows: DataFrame, value: Column, name: str, by: list[str] = [], back: bool = False) -> DataFrame:  # noqa: B006
    """Adds the last value that is not null at or before each row (back: the first at or after it), among rows of the
    same `by` values, which the rows are sorted by first. rows come from in_ranges()."""
    held = F.when(value.isNotNull(), F.struct(*[F.col(f"`{c}`") for c in by], value.alias("__value")))
    rows = rows.withColumn("__held", held)
    place = F.when(F.col("__held").isNotNull(), F.col("__at"))
    ends = rows.groupBy("__part").agg((F.min_by if back else F.max_by)("__held", place).alias("__end"))
    # a row a range
    others = W.orderBy(F.desc("__part") if back else F.asc("__part")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("__part", F.last("__end", ignorenulls=True).over(others).alias("__beyond"))
    frame = (inside_back() if back else inside()).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("__near", F.last("__held", ignorenulls=True).over(frame)).join(F.broadcast(ends), "__part")
    found = found.withColumn("__near", F.coalesce("__near", "__beyond"))
    return found.withColumn(name, F.when(_same(by, F.col("__near")), F.col("__near.__value"))).drop("__held", "__near", "__beyond")


def positions(rows: DataFrame, name: str = "__pos") -> DataFrame:
    """Adds each row's number from 1 in the whole order, from the sizes of the ranges before, and __total."""
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("__total"))
    return rows.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__base")


def with_neighbours(rows: DataFrame, before: int, after: int) -> DataFrame:
    """The rows of each range with `before` rows of the ranges before it and `after` of those after it, marked by __copy.

    rows have __pos. A range gets copies of at most before + after rows, whatever its size; ranges that are shorter than
    that take them from several neighbours.
    """
    bounds = rows.groupBy("__part").agg(F.min("__pos").alias("__low"), F.max("__pos").alias("__high"))
    wanted = F.concat(
        F.sequence(F.greatest(F.col("__low") - before, F.lit(1)), F.col("__low") - 1) if before else F.array().cast("array<long>"),
        F.sequence(F.col("__high") + 1, F.col("__high") + after) if after else F.array().cast("array<long>"),
    )
    safe = F.filter(wanted, lambda p: (p < F.col("__low")) | (p > F.col("__high")))  # a sequence to a lower end counts down
    needed = bounds.select(F.col("__part").alias("__to"), F.explode(safe).alias("__pos"))
    near = rows.join(bounds, "__part").filter((F.col("__pos") < F.col("__low") + after) | (F.col("__pos") > F.col("__high") - before)).drop("__low", "__high")
    copies = near.join(needed, "__pos").withColumn("__part", F.col("__to")).drop("__to").withColumn("__copy", F.lit(True))
    return rows.withColumn("__copy", F.lit(False)).unionByName(copies.select(*rows.columns, "__copy"))


def framed(rows: DataFrame, columns: dict[str, Column], before: int, after: int) -> DataFrame:
    """Adds columns that are computed over a window (see frame()) reaching so many rows back and ahead. rows have __pos."""
    wide = with_neighbours(rows, before, after)
    return wide.withColumns(columns).filter(~F.col("__copy")).drop("__copy")


def frame() -> W:
    """The window of framed(): a range's rows in order, with its neighbours."""
    return W.partitionBy("__part").orderBy("__pos")


def shifted(rows: DataFrame, value: Column, by: int, name: str) -> DataFrame:
    """Adds the value `by` rows before (after, if negative), null beyond the ends."""
    return framed(rows, {name: F.lag(value, by).over(frame())}, max(0, by), max(0, -by))


def tiles(rows: DataFrame, count: int, name: str) -> DataFrame:
    """Adds which of so many tiles, from 1, a row falls in; the first ones are a row larger. rows have __pos."""
    if count < 1:
        raise PlanError("TILES_INVALID", str(count))
    size, more = F.floor(F.col("__total") / count), F.col("__total") % count
    at = F.col("__pos") - 1
    tile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.withColumn(name, (tile + 1).cast("int"))


def ranks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank, dense_rank (long) and percent_rank by the order columns that rows are sorted by first. rows have __pos."""
    rows = shifted(rows.withColumn("__key", F.struct(*[F.col(f"`{c}`") for c in order])), F.col("__key"), 1, "__last")
    rows = rows.withColumn("__new", (F.col("__pos") == 1) | ~F.col("__key").eqNullSafe(F.col("__last")))
    rows = carried(rows, F.when(F.col("__new"), F.col("__pos")), "rank")
    sums = rows.groupBy("__part").agg(F.count_if("__new").alias("__n"))
    bases = sums.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # a row a range
    within = F.sum(F.col("__new").cast("long")).over(inside().rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__in", within).join(F.broadcast(bases), "__part").withColumn("dense_rank", F.col("__base") + F.col("__in"))
    rows = rows.withColumn("percent_rank", F.when(F.col("__total") > 1, (F.col("rank") - 1) / (F.col("__total") - 1)).otherwise(0.0))
    return rows.drop("__key", "__last", "__new", "__in", "__base")


def range_sums(df: DataFrame, at: str, values: dict[str, Column], before: Column | int, after: Column | int) -> DataFrame:
    """Adds the sum of each value over the rows whose `at` lies between the row's own less `before` and plus `after`.

    Sums run over the different values of `at`, grouped first: a frame is the difference of two running totals, each
    found by an as-of join. So neither a wide frame nor a value that many rows share copies rows. Nulls of `at` are a
    frame of their own, as in SQL; before and after are numbers, or intervals for times.
    """
    names = list(values)
    grouped = df.groupBy(F.col(at).alias("__v")).agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(values.values())])
    grouped = written(grouped, "values")
    totals = grouped.filter("__v IS NOT NULL")
    for i, _ in enumerate(names):
        totals = running_total(totals, F.col(f"__s{i}"), f"__t{i}", ["__v"])
    totals = written(totals.select("__v", *[f"__t{i}" for i in range(len(names))]), "totals")
    ends = totals.select("__v", (F.col("__v") + after).alias("__high"), (F.col("__v") - before).alias("__low"))
    known = totals.withColumnRenamed("__v", "__k")
    high = asof_join(ends, known, "__high", "__k", ties=[])
    high = high.select("__v", "__low", *[F.col(f"__t{i}").alias(f"__h{i}") for i in range(len(names))])
    low = asof_join(high, known, "__low", "__k", strict=True, ties=[])
    sums = low.select("__v", *[(F.col(f"__h{i}") - F.coalesce(F.col(f"__t{i}"), F.lit(0))).alias(n) for i, n in enumerate(names)])
    alone = grouped.filter("__v IS NULL").select("__v", *[F.col(f"__s{i}").alias(n) for i, n in enumerate(names)])
    return df.join(sums.unionByName(alone), F.col(at).eqNullSafe(F.col("__v"))).drop("__v")


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, left_by: list[str] = [], right_by: list[str] = [],  # noqa: B006
    how: str = "left", strict: bool = False, forward: bool = False, within: Column | None = None, ties: list[str] | None = None,
) -> DataFrame:
    """Each left row with the last right row of the same key at or before its time.

    strict leaves out equal times, forward takes the first right row at or after it, within bounds the distance of the
    two times; how is left or inner. Of right rows of one key and time that with the greatest `ties` columns counts (all
    its columns if not given). Null keys or times match nothing. Right columns whose name the left side has get _right
    behind. Both sides are sorted together by key and time, right rows first at equal times unless strict, and the last
    right row is carried on: over the ranges' edges too, so that a key with half of all rows is many tasks.
    """
    if how not in ("left", "inner") or len(left_by) != len(right_by):
        raise PlanError("ASOF_JOIN_INVALID", how)
    for df, names in ((left, [left_time, *left_by]), (right, [right_time, *right_by, *(ties or [])])):
        if missing := [c for c in names if c not in df.columns]:
            raise PlanError("ASOF_JOIN_FIELDS_NOT_FOUND", ", ".join(missing))
    of = lambda c: F.col(f"`{c}`")
    keys = [f"__k{i}" for i in range(len(left_by))]
    shared = right.filter(reduce(lambda a, b: a & b, [of(c).isNotNull() for c in [right_time, *right_by]]))
    kind = shared.select(F.struct(*[of(c) for c in right.columns]).alias("__right")).schema["__right"].dataType
    lefts = left.select(*[of(c).alias(k) for c, k in zip(left_by, keys)], of(left_time).alias("__time"), F.lit(not strict).alias("__late"), F.struct(*[of(c) for c in left.columns]).alias("__left"), F.lit(None).cast(kind).alias("__right"))
    rights = shared.select(*[of(c).alias(k) for c, k in zip(right_by, keys)], of(right_time).alias("__time"), F.lit(strict).alias("__late"), F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"), F.struct(*[of(c) for c in right.columns]).alias("__right"))
    both = lefts.unionByName(rights)
    # the hash deals left rows of one key and time, nulls above all, out over ranges
    order = [F.col("__time").desc() if forward else F.col("__time").asc(), "__late", *[F.col("__right")[c] for c in (right.columns if ties is None else ties)], F.xxhash64("__left")]
    rows = carried(in_ranges(both, *keys, *order), F.col("__right"), "__match", keys)
    met = F.col("__time").isNotNull()
    for k in keys:
        met &= F.col(k).isNotNull()
    if within is not None:
        met &= (F.col("__match")[right_time] - F.col("__time") if forward else F.col("__time") - F.col("__match")[right_time]) <= within
    rows = rows.filter(F.col("__left").isNotNull()).withColumn("__match", F.when(met, F.col("__match")))
    if how == "inner":
        rows = rows.filter(F.col("__match").isNotNull())
    taken = set(left.columns)
    return rows.select(*[F.col("__left")[c].alias(c) for c in left.columns], *[F.col("__match")[c].alias(f"{c}_right" if c in taken else c) for c in right.columns])


def fill(df: DataFrame, columns: list[str], order: list[str], by: list[str] = [], back: bool = False) -> DataFrame:  # noqa: B006
    """Nulls of the columns take the last value before (back: the first after) in the order, within each `by` value."""
    if missing := [c for c in [*columns, *order, *by] if c not in df.columns]:
        raise PlanError("FILL_FIELDS_NOT_FOUND", ", ".join(missing))
    rows = in_ranges(df, *[f"`{c}`" for c in [*by, *order]])
    for c in columns:
        rows = carried(rows, F.col(f"`{c}`"), "__filled", by, back).withColumn(c, F.col("__filled")).drop("__filled")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])

