"""New files of a folder as they arrive: a file stream through a plan's stages, with what was done kept by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest_new_files(spark: SparkSession, folder: str, schema: StructType | str, checkpoint: str, output: str, stage: Callable[[DataFrame], DataFrame] = lambda df: df, kind: str = "parquet", **options) -> int:
    """Reads the files that no earlier call has read, applies a stage to each batch and appends to output; returns the
    rows. A file counts as read by its path. A batch that is written again after a failure replaces itself, as its
    folder has its number."""
    stream = spark.readStream.schema(schema).format(kind).options(**options).load(folder).withColumn("__source_file", F.col("_metadata.file_name"))
    done = []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{output}/batch={number}"
        stage(batch).write.mode("overwrite").parquet(path)
        done.append(spark.read.parquet(path).count())

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(done)
