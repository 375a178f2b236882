"""Comparison of two versions of a table by trees of hashes: only key ranges whose hashes differ are compared cell by cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.tables import written

#: Each node has 2 ** STEP children; leaves are ranges of the keys' hash.
STEP = 4


def _marked(columns: list[str]) -> list[Column]:
    """Values with a mark for null each, as Spark's hashes skip nulls."""
    return [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]


def _leaf(keys: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("leaf"), *_marked(keys)), 64 - bits)


def hash_tree(df: DataFrame, keys: list[str], columns: list[str] | None = None, bits: int = 16) -> DataFrame:
    """Nodes of a table's tree, written below spark.checkpoint.dir: level (0 is the root), node, rows, digest, mix.

    A leaf adds up the hashes of the rows whose key's hash falls in its range, in any order; a node adds up its children.
    A task combines before the shuffle, so that 2 ** bits small rows a task are all that moves.
    """
    names = columns or df.columns
    if missing := [c for c in (*keys, *names) if c not in df.columns]:
        raise PlanError("COMPARE_FIELDS_NOT_FOUND", ", ".join(missing))
    if not keys or bits % STEP or not STEP <= bits <= 24:
        raise PlanError("COMPARE_INVALID", f"{keys} {bits}")
    every = sorted({*names, *keys})
    rows = df.select(_leaf(keys, bits).alias("node"), F.xxhash64(F.lit(1), *_marked(every)).alias("a"), F.xxhash64(F.lit(2), *_marked(every)).alias("b"))
    levels = [rows.groupBy("node").agg(F.count("*").alias("rows"), F.sum(F.col("a").cast("decimal(38,0)")).alias("digest"), F.bit_xor("b").alias("mix")).withColumn("level", F.lit(bits // STEP))]
    levels = [written(levels[0], "leaves")]
    for level in range(bits // STEP - 1, -1, -1):
        up = levels[-1].groupBy(F.shiftright("node", STEP).alias("node")).agg(F.sum("rows").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"), F.bit_xor("mix").alias("mix"))
        levels.append(up.withColumn("level", F.lit(level)))
    return written(reduce(DataFrame.unionByName, levels), "tree")


def different_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves in which two trees of one shape differ, found from the root down: children are read only of nodes that differ."""
    deepest = a.unionByName(b).agg(F.max("level")).first()[0] or 0
    nodes = a.sparkSession.createDataFrame([(0,)], "node long")
    for level in range(deepest + 1):
        at = lambda tree, mark: tree.filter(F.col("level") == level).select("node", F.struct("rows", "digest", "mix").alias(mark))  # noqa: B023, E731
        both = at(a, "x").join(at(b, "y"), "node", "full").filter(~F.col("x").eqNullSafe(F.col("y")))
        if level:
            both = both.join(F.broadcast(nodes), F.shiftright(both["node"], STEP) == nodes["node"], "left_semi")
        nodes = written(both.select("node"), "nodes")
        if nodes.isEmpty():
            break
    return nodes


CELLS = "change string, column string, before string, after string"


def compare(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, trees: tuple[DataFrame, DataFrame] | None = None, bits: int = 16) -> DataFrame:
    """A row for each difference: the keys, change (added, removed or changed), column (null for whole rows), and the cell
    before and after as text.

    Rows with the same key on both sides are compared by `columns` (all that both have, if not given); null cells and null
    keys are equal to each other. Keys must be unique where tables differ. trees gives both hash_tree()s, if they are there
    from an earlier comparison; equal tables are then told by reading one node each, and no row.
    """
    names = [c for c in (columns or [c for c in old.columns if c in new.columns]) if c not in keys]
    a, b = trees or (hash_tree(old, keys, names, bits), hash_tree(new, keys, names, bits))
    leaves = different_leaves(a, b)
    out = [F.col(f"`{k}`") for k in keys]
    if leaves.isEmpty():
        return old.select(*out).limit(0).select("*", *[F.lit(None).cast("string").alias(c) for c in ("change", "column", "before", "after")])
    leaves = F.broadcast(leaves.select(F.col("node").alias("__leaf")))  # 2 ** bits at most

    def part(df: DataFrame, side: str) -> DataFrame:
        near = df.withColumn("__at", _leaf(keys, bits)).join(leaves, F.col("__at") == F.col("__leaf"), "left_semi")
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in names]) if names else F.array().cast("array<struct<c:string,v:string>>")
        return written(near.select(*[F.col(f"`{k}`").alias(f"__{side}{i}") for i, k in enumerate(keys)], cells.alias(side), F.xxhash64(*_marked(keys)).alias("__key")), side)

    x, y = part(old, "x"), part(new, "y")
    for side, name in ((x, "x"), (y, "y")):
        if not side.groupBy(*[f"__{name}{i}" for i in range(len(keys))]).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise PlanError("COMPARE_KEYS_NOT_UNIQUE", ", ".join(keys))
    y = y.withColumnRenamed("__key", "__other")
    same = reduce(lambda p, q: p & q, [F.col(f"__x{i}").eqNullSafe(F.col(f"__y{i}")) for i in range(len(keys))], F.col("__key") == F.col("__other"))
    both = x.join(y, same, "full")
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("change"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    cells = F.filter(F.arrays_zip("x", "y"), lambda c: ~c["x"]["v"].eqNullSafe(c["y"]["v"]))
    changed = F.transform(cells, lambda c: F.struct(F.lit("changed").alias("change"), c["x"]["c"].alias("column"), c["x"]["v"].alias("before"), c["y"]["v"].alias("after")))
    found = F.when(F.col("x").isNull(), whole("added")).when(F.col("y").isNull(), whole("removed")).otherwise(changed)
    key = [F.when(F.col("x").isNull(), F.col(f"__y{i}")).otherwise(F.col(f"__x{i}")).alias(k) for i, k in enumerate(keys)]
    return both.select(*key, F.explode(found).alias("__d")).select(*out, "__d.*")
