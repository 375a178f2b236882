"""What several corpus operators share: word patterns, written tables, spans found natively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepweave.tables import fresh_path as shared_dir  # noqa: F401
from prepweave.tables import written  # noqa: F401

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Lengths of the pieces in which a running sum is built.
BLOCK = 256


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more, so that a long job does not fill the shared folder."""
    for df in tables:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()} if df is not None else ():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` or a lambda in it reads it: Spark copies an expression
    to each place that names it, but not one that a lambda variable is bound to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_name(*columns: Column | str) -> Column:
    """A 128-bit name of the values, never null; nulls are equal to each other and to nothing else."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.md5(c.cast("string")), F.lit("null")) for c in cells])))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a written table for broadcast if it has at most so many rows; otherwise Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def merged(df: DataFrame) -> DataFrame:
    """Marks a side for a join by sorting. Spark takes a table of exploded or collected rows for no larger than what it is
    made of, or than its compressed file, and so would broadcast sides of many times its own limit through the driver."""
    return df.hint("merge")


def drawn(share: Column | float, *key: Column | str) -> Column:
    """Whether a row belongs to a sample of so large a share, told from 63 bits of the key's hash, so that small shares of
    very many rows are told apart too."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.xxhash64(F.lit("sample"), *key).bitwiseAND(2**63 - 1).cast("double") <= share * F.lit(2.0**63)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array of longs. Each value is read once, and sums move to the result a block at a
    time, so that a long array is not copied for each of its values."""
    empty = F.array().cast("array<bigint>")

    def step(acc, v):
        total = acc["total"] + v
        full = F.size(acc["block"]) >= BLOCK - 1
        block = F.concat(acc["block"], F.array(total))
        return F.struct(
            F.when(full, F.concat(acc["done"], block)).otherwise(acc["done"]).alias("done"),
            F.when(full, empty).otherwise(block).alias("block"),
            total.alias("total"),
        )

    start = F.struct(empty.alias("done"), empty.alias("block"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(values, start, step, lambda acc: F.concat(acc["done"], acc["block"]))


def hits_and_gaps(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Adds for each kind the matches of its pattern and the pieces between them.

    A pattern comes with a cheap condition that every text with a match meets, or None.
    """
    columns = {}
    for kind, (pattern, maybe) in patterns.items():
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split(F.col(text), pattern, -1), F.length)
        empty = F.array().cast("array<string>"), F.array().cast("array<int>")
        columns[f"__hits_{kind}"] = hits if maybe is None else F.when(maybe, hits).otherwise(empty[0])
        columns[f"__gaps_{kind}"] = gaps if maybe is None else F.when(maybe, gaps).otherwise(empty[1])
    return with_steps(df.withColumns(columns), patterns)


def with_steps(df: DataFrame, kinds) -> DataFrame:
    """Adds for each kind, from its matches and gaps, how far each match's start lies behind the last one's."""

    def steps(kind):
        # arrays meet by zip_with: an array that a lambda reaches by index may be computed anew for each element
        hits = F.transform(f"__hits_{kind}", F.length)
        both = F.zip_with(f"__gaps_{kind}", F.concat(F.array(F.lit(0)), hits), lambda g, h: (g + h).cast("long"))
        return F.when(F.size(f"__hits_{kind}") > 0, F.slice(both, F.lit(1), F.size(f"__hits_{kind}"))).otherwise(F.array().cast("array<bigint>"))

    return df.withColumns({f"__steps_{k}": steps(k) for k in kinds})


def without(df: DataFrame, kinds) -> DataFrame:
    return df.drop(*[f"__{part}_{k}" for part in ("hits", "gaps", "steps") for k in kinds])


def spans(kind: str) -> Column:
    """The matches of a kind as structs of kind, start, end (code points, end exclusive) and the matched text."""
    return F.zip_with(
        running_sum(F.col(f"__steps_{kind}")),
        F.col(f"__hits_{kind}"),
        lambda s, h: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(h)).alias("end"), h.alias("hit")),
    )


def span_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def cut_out(text: Column, found: Column, replacement) -> Column:
    """The text with each span replaced; spans are in order and do not overlap. replacement maps a span to a text."""
    count = F.size(found)
    before = F.transform(
        found,
        lambda x, i: F.concat(
            F.substring(text, (F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0) + 1).cast("int"), (x["start"] - F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0)).cast("int")),
            replacement(x),
        ),
    )
    tail = F.substring(text, (F.element_at(found, -1)["end"] + 1).cast("int"), F.length(text))
    return F.when(count > 0, F.concat(F.array_join(before, ""), tail)).otherwise(text)
