"""Rules over several tables and columns: references, keys and functional dependencies, found exactly."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.tables import written

#: Bits of a filter for each key, hashes for each key, and the largest filter that is broadcast.
BITS, HASHES, MOST_BYTES = 10, 5, 64 << 20
#: Estimated numbers of different values within this share of each other are told apart by exact counts.
NEAR, ERROR = 0.15, 0.02


def _known(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise PlanError("INTEGRITY_FIELDS_NOT_FOUND", ", ".join(missing))


def _positions(keys: list[str], bits: Column | int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(bits)) for i in range(HASHES)])


def filter_of(keys: DataFrame, names: list[str], bits: int) -> DataFrame:
    """A Bloom filter of the rows as pieces (bucket, bitmap) of 32,768 bits each."""
    each = keys.select(F.explode(_positions(names, bits)).alias("p"))
    return each.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """Keys of the child that the parent has not: the child's key columns and n, the rows with them. A key with a null refers to
    nothing and is no orphan.

    The child's keys are counted first, so that a frequent one is one row. A Bloom filter of the parent's keys then tells
    most orphans without the parent's rows; keys that pass it are confirmed by a join. A filter beyond most_bytes is not
    built, and all keys are joined.
    """
    if len(child_keys) != len(parent_keys) or not child_keys:
        raise PlanError("INTEGRITY_INVALID", f"{child_keys} {parent_keys}")
    _known(child, child_keys), _known(parent, parent_keys)
    names = [f"__k{i}" for i in range(len(child_keys))]
    full = lambda df, keys: df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).dropna()
    counted = full(child, child_keys).groupBy(*names).agg(F.count("*").alias("n"))
    kinds = counted.schema
    parents = full(parent, parent_keys).select(*[F.col(n).cast(kinds[n].dataType).alias(n) for n in names]).distinct()
    parents = written(parents, "parents")
    bits = max(32_768, BITS * parents.count())
    out = [F.col(n).alias(k) for n, k in zip(names, child_keys)] + ["n"]
    if bits // 8 > most_bytes:
        return counted.join(parents, names, "left_anti").select(*out)
    pieces = F.broadcast(filter_of(parents, names, bits))
    counted = written(counted, "children")
    probes = counted.withColumn("p", F.explode(_positions(names, bits)))
    probes = probes.join(pieces, F.bitmap_bucket_number("p") == F.col("bucket"), "left")
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    passed = probes.groupBy(*names, "n").agg(F.bool_and(there).alias("maybe"))
    passed = written(passed, "passed")
    wrongly = passed.filter("maybe").join(parents, names, "left_anti")
    return passed.filter("NOT maybe").unionByName(wrongly).select(*out)


def _marked(columns: tuple[str, ...]) -> list[Column]:
    return [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]


def dependencies(df: DataFrame, columns: list[str] | None = None, most: int = 2) -> DataFrame:
    """Minimal keys and functional dependencies among columns, with at most `most` columns on the left: determinant
    (column names, comma-joined), dependent (null for a key). Null is a value like others.

    Levels go up by size. A set that holds a key, or a determinant of the same column, is not looked at again. What is left
    of a level is estimated in one pass; only sets whose estimates allow a dependency are counted exactly, a set of columns in
    one grouping each. A table without rows has none.
    """
    names = columns or df.columns
    _known(df, names)
    rows = written(df.select(*[F.col(f"`{c}`") for c in names]), "dependencies")
    total = rows.count()
    found: list[tuple[str, str | None]] = []
    keys: list[frozenset] = []
    known: dict[str, list[frozenset]] = {c: [] for c in names}
    different: dict[frozenset, float] = {}

    def estimate(sets: list[frozenset]) -> None:
        """About how many different values sets have; in passes of 60."""
        new = [s for s in dict.fromkeys(sets) if s not in different]
        for i in range(0, len(new), 60):
            some = new[i : i + 60]
            row = rows.agg(*[F.approx_count_distinct(F.xxhash64(*_marked(tuple(sorted(s)))), ERROR).alias(str(k)) for k, s in enumerate(some)]).first()
            different.update({s: row[k] for k, s in enumerate(some)})

    for size in range(1, (most if total else 0) + 1):
        sets = [frozenset(c) for c in combinations(names, size)]
        sets = [s for s in sets if not any(k <= s for k in keys)]
        right = {s: [c for c in names if c not in s and not any(d <= s for d in known[c])] for s in sets}
        estimate(sets + [s | {c} for s in sets for c in right[s]])
        for s in sets:
            able = [c for c in right[s] if different[s] >= (1 - NEAR) * different[s | {c}]]
            key = different[s] >= (1 - NEAR) * total
            if not able and not key:
                continue
            left = [c for c in names if c in s]
            one = lambda c: (F.count(F.when(F.col(f"`{c}`").isNull(), 1)) > 0).cast("int") + F.when(F.min(f"`{c}`").isNull(), 0).when(F.min(f"`{c}`") == F.max(f"`{c}`"), 1).otherwise(2)
            groups = rows.groupBy(*[F.col(f"`{c}`") for c in left]).agg(F.count("*").alias("__n"), *[one(c).alias(f"__{i}") for i, c in enumerate(able)])
            worst = groups.agg(F.max("__n"), *[F.max(f"__{i}") for i in range(len(able))]).first()
            if worst[0] == 1:
                keys.append(s)
                found.append((",".join(left), None))
                continue
            for c, n in zip(able, worst[1:]):
                if n <= 1:
                    known[c].append(s)
                    found.append((",".join(left), c))
    return df.sparkSession.createDataFrame(found, "determinant string, dependent string")
