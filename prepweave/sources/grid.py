"""Delimited files as numbered grids of text: the delimiter from the head, encoding, width and quoting from one pass."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.errors import PlanError
from prepweave.tables import written

DELIMITERS = ",;\t|"
ROW = "__rn"
HEAD_LINES = 100
#: Spark's reader knows Latin-1; where Windows-1252 differs from it, the rest is a translation of characters.
LATIN = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    encoding: str = "UTF-8"
    width: int = 0
    multi_line: bool = False


def _split_count(line: str, delimiter: str) -> int:
    """Delimiters outside quotes."""
    return sum(part.count(delimiter) for part in line.split('"')[::2])


def _count(c: str, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(F.col(c), F.lit(mark), F.lit("")))


def sniff(spark: SparkSession, path: str) -> Dialect:
    """The dialect of a file. The head tells the delimiter (that which stands equally often in most lines, a comma if none
    does); a pass over the lines tells encoding (UTF-8 if all lines are, else Windows-1252), width and whether quotes span
    lines."""
    lines = spark.read.text(path)
    head = [bytes(r[0]) for r in lines.limit(HEAD_LINES).select(F.col("value").cast("binary")).collect()]
    if not head:
        return Dialect()
    try:
        texts = [h.decode("utf-8") for h in head]
    except UnicodeDecodeError:
        texts = [h.decode("cp1252", "replace") for h in head]

    def steady(d: str) -> tuple[float, int]:
        counts = [_split_count(t, d) for t in texts if t.strip()]
        if not counts or not any(counts):
            return 0.0, 0
        usual = max(set(counts), key=lambda n: (counts.count(n), n))
        return (counts.count(usual) / len(counts) if usual else 0.0), usual

    delimiter = max(DELIMITERS, key=lambda d: (*steady(d), -DELIMITERS.index(d)))
    delimiter = delimiter if steady(delimiter)[1] else ","
    facts = lines.agg(F.max(_count("value", delimiter)).alias("most"), F.max(F.when(_count("value", '"') % 2 == 1, 1).otherwise(0)).alias("odd"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")).first()
    return Dialect(delimiter, "UTF-8" if facts["utf8"] else "windows-1252", (facts["most"] or 0) + 1, bool(facts["odd"]))


def read_grid(spark: SparkSession, path: str, dialect: Dialect | None = None, limit: int | None = None) -> DataFrame:
    """Columns __rn (from 1, in file order, files of a folder by path) and _c0 .. _cn; all text, null where a row is short
    or a cell empty. An empty line is a row without a cell.

    Lines are read with their place and parsed afterwards, as a reader of delimited files would leave out empty ones. Rows
    are numbered without a shuffle: a line's place in its input split plus the rows of the splits before, of which the
    driver sees a count each. Where quotes span lines, lines are put together to rows first (see _records). limit keeps
    the first rows, for previews.
    """
    d = dialect or sniff(spark, path)
    if not d.width:
        return spark.createDataFrame([], f"{ROW} long, _c0 string")
    if d.encoding == "windows-1252":
        value = F.translate(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "".join(a for a, b in LATIN if b), "".join(b for _, b in LATIN))
    else:
        value = F.when(F.col("_metadata.file_block_start") == 0, F.ltrim("value", F.lit("\ufeff"))).otherwise(F.col("value"))  # a byte order mark
    lines = spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__mono"))
    if limit and not d.multi_line:
        lines = lines.limit(limit)
    rows, width = (_records(lines, d.delimiter) if d.multi_line else _numbered(lines)), d.width
    if d.multi_line:  # a row's cells may stand in several lines
        width = (rows.agg(F.max(_count("value", d.delimiter))).first()[0] or 0) + 1
    schema = ", ".join(f"_c{i} string" for i in range(width))
    options = {"sep": d.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = rows.select(ROW, F.when(F.col("value") != "", F.from_csv("value", schema, options)).alias("__cells"))
    out = parsed.select(ROW, *[F.col(f"__cells._c{i}").alias(f"_c{i}") for i in range(width)])
    return out.filter(F.col(ROW) <= limit) if limit else out


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number in the order of path and place."""
    splits = lines.groupBy("__path", "__block").agg(F.min("__mono").alias("m"), F.count("*").alias("n")).collect()  # one row an input split
    places, total = [], 0
    for s in sorted(splits, key=lambda r: (r["__path"], r["__block"])):
        places.append((s["__path"], s["__block"], total - s["m"] + 1))
        total += s["n"]
    shifts = lines.sparkSession.createDataFrame(places, "__path string, __block long, __shift long")
    return lines.join(F.broadcast(shifts), ["__path", "__block"]).select((F.col("__mono") + F.col("__shift")).alias(ROW), "value")


def line_end(line: str, delimiter: str, quoted: bool) -> bool:
    """Whether a line ends inside quotes, if it begins inside them or not. A quote opens only at a cell's begin."""
    at = 0
    while True:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            quoted = False
        elif line[at : at + 1] == '"':
            quoted, at = True, at + 1
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def _records(lines: DataFrame, delimiter: str) -> DataFrame:
    """Rows of which some span lines, with their number; a file of any size is read in parallel.

    What a line does to the state (outside or inside quotes) keeps, turns or sets it. So the state before a line follows
    from the last line that set it and the number of turns since, within the line's split; the driver carries the state
    over the splits, of which it sees one row each. Rows begin at lines that begin outside quotes.
    """

    @F.pandas_udf("sets boolean, turns int")
    def effect(values: pd.Series) -> pd.DataFrame:
        ends = [(line_end(x, delimiter, False), line_end(x, delimiter, True)) if '"' in x else (False, True) for x in values]
        return pd.DataFrame({"sets": pd.Series([a if a == b else None for a, b in ends], dtype="boolean"), "turns": [int(a and not b) for a, b in ends]})

    split = W.partitionBy("__path", "__block").orderBy("__mono")
    before, to_here = split.rowsBetween(W.unboundedPreceding, -1), split.rowsBetween(W.unboundedPreceding, 0)
    lines = written(lines.withColumn("__effect", effect("value")), "lines")
    lines = lines.withColumn("__turns", F.sum("__effect.turns").over(to_here)).withColumn("__set", F.when(F.col("__effect.sets").isNotNull(), F.struct(F.col("__effect.sets").cast("int").alias("to"), F.col("__turns").alias("at"))))
    state = lambda turns, last, base: F.when(last.isNull(), base + turns).otherwise(last["to"] + turns - last["at"]) % 2
    last = F.max_by("__set", F.when(F.col("__set").isNotNull(), F.col("__mono")))
    splits = lines.groupBy("__path", "__block").agg(state(F.max("__turns"), last, F.lit(0)).alias("from0"), state(F.max("__turns"), last, F.lit(1)).alias("from1")).collect()  # one row an input split
    begins, inside, path = [], 0, None
    for s in sorted(splits, key=lambda r: (r["__path"], r["__block"])):
        inside, path = (inside if s["__path"] == path else 0), s["__path"]
        begins.append((path, s["__block"], inside))
        inside = s["from1"] if inside else s["from0"]
    spark = lines.sparkSession
    lines = lines.join(F.broadcast(spark.createDataFrame(begins, "__path string, __block long, __base int")), ["__path", "__block"])
    here = state(F.coalesce(F.sum("__effect.turns").over(before), F.lit(0)), F.last("__set", True).over(before), F.col("__base"))
    lines = written(lines.select("__path", "__block", "__mono", "value", (here == 0).alias("__starts")), "starts")
    counts = {(r["__path"], r["__block"]): r["n"] for r in lines.groupBy("__path", "__block").agg(F.count_if("__starts").alias("n")).collect()}
    bases, total = [], 0
    for key in sorted(counts):
        bases.append((*key, total))
        total += counts[key]
    lines = lines.join(F.broadcast(spark.createDataFrame(bases, "__path string, __block long, __base long")), ["__path", "__block"])
    lines = lines.withColumn(ROW, F.col("__base") + F.count_if("__starts").over(to_here))
    whole = lines.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("__block", "__mono", "value"))).alias("all"))
    return whole.select(ROW, F.array_join("all.value", "\n").alias("value"))


def cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_c")]


def read_source(spark: SparkSession, path: str, sheet: str | None = None, limit: int | None = None) -> DataFrame:
    """The grid of a file by its ending."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv", "txt"):
        return read_grid(spark, path, limit=limit)
    if ending in ("xlsx", "xlsm"):
        from prepweave.sources.xlsx import read_sheet

        out = read_sheet(spark, path, sheet)
        return out.limit(limit) if limit else out
    if ending == "parquet":
        from prepweave.operators.mapping import with_row_ids

        table = spark.read.parquet(path)
        numbered = with_row_ids(table, table.columns)
        return numbered.select(F.col("__row_id").alias(ROW), *[F.col(f"`{c}`").cast("string").alias(f"_c{i}") for i, c in enumerate(table.columns)])
    raise PlanError("SOURCE_UNSUPPORTED_TYPE", ending)
