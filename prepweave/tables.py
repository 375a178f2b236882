"""Tables that a plan writes on its way."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: The setting that names the folder of the run that is on, below spark.checkpoint.dir.
RUN = "prepweave.run.folder"


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """All tables that are written on the way within it lie in one folder, which goes at the end. Results must be written
    elsewhere, or read, before."""
    before, path = spark.conf.get(RUN, None), fresh_path(spark, name)
    spark.conf.set(RUN, path)
    try:
        yield path
    finally:
        spark.conf.set(RUN, before) if before else spark.conf.unset(RUN)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of the run that is on, or below spark.checkpoint.dir, which the driver and all executors
    reach."""
    base = spark.conf.get(RUN, None) or spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/prepweave"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table at a fresh_path(): what reads it twice reads the same rows both times, also after an
    executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() made, when nothing reads them any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows sorted by range over all tasks and written once, with the number of their range (__part) and a number that
    grows with the order (__at), as two plans would not cut the same ranges."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return written(placed, "ranges").withColumn("__part", F.shiftright("__at", 33))


def fits_task(df: DataFrame, most: int = 32 << 20) -> bool:
    """Whether Spark's own estimate says that a table is so small that one task may sort all of it. Joins are estimated by
    the product of their sides, and plans that make rows out of rows are not trusted."""
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    return not any(x in text for x in ("Generate", "Expand", "MapIn", "Python", "LogicalRDD", "Range (")) and int(str(plan.stats().sizeInBytes())) <= most


def numbered_within(df: DataFrame, name: str, order: list, by: str) -> DataFrame:
    """Adds each row's number from 1 in an order within each value of the column `by` (never null).

    Rows are sorted by range and written; a row's number is its place in the whole order less that of its value's first
    row, so that a frequent value is as many tasks as it has ranges, and no window is needed.
    """
    if fits_task(df):
        return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long"))
    rows = in_ranges(df, by, *order)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # a row a range
    rows = rows.join(F.broadcast(bases), "__part").withColumn("__place", F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    begins = rows.groupBy(by).agg(F.min("__place").alias("__begin"))
    return rows.join(begins, by).withColumn(name, F.col("__place") - F.col("__begin") + 1).drop("__part", "__at", "__base", "__place", "__begin")


def running_total(df: DataFrame, value: Column, name: str, order: list, by: str | None = None) -> DataFrame:
    """Adds the inclusive running total of value in an order, within each value of the column `by` (never null) if given.

    Each range is summed on its own and starts from the sum of those before it, so neither a frequent group nor the whole
    table is one task. Nulls add nothing.
    """
    groups = [by] if by else []
    rows = in_ranges(df, *groups, *order)
    sums = rows.groupBy("__part", *groups).agg(F.sum(value).alias("__sum"))
    kind = sums.schema["__sum"].dataType
    earlier = F.sum("__sum").over(W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    bases = sums.select("__part", *groups, F.coalesce(earlier.cast(kind), F.lit(0).cast(kind)).alias("__base"))
    inside = F.sum(value).over(W.partitionBy("__part", *groups).orderBy("__at").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(bases, ["__part", *groups]).withColumn(name, (F.col("__base") + F.col("__inside")).cast(kind)).drop("__part", "__at", "__inside", "__base")
