"""Event-time streams: deduplication, windows and sessions with watermarks, on Spark's state store.

Each function takes a stream and gives a stream; run() writes one to a folder until its source has no more. Rows may come
out of order by up to `delay`. Rows later than that are left out by Spark; run() returns how many were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prepweave.errors import PlanError


def replay(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int = 1, kind: str = "parquet") -> DataFrame:
    """The files of a folder as a stream, in order of their time, so many at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(kind).load(folder)


def _with_watermark(stream: DataFrame, time: str, delay: str) -> DataFrame:
    if time not in stream.columns:
        raise PlanError("STREAM_FIELDS_NOT_FOUND", time)
    return stream.withWatermark(time, delay)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key that comes; a repeat may come up to `delay` of event time later. State is a row a key,
    let go of when the watermark passes it."""
    return _with_watermark(stream, time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, keys: list[str], time: str, delay: str, width: str, measures: dict[str, Column], slide: str | None = None, watermarked: bool = False) -> DataFrame:
    """Measures of each key in windows of event time, given once the watermark has passed a window."""
    rows = stream if watermarked else _with_watermark(stream, time, delay)
    out = rows.groupBy(F.window(time, width, slide), *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(*keys, F.col("window.start").alias("since"), F.col("window.end").alias("until"), *measures)


def sessions(stream: DataFrame, keys: list[str], time: str, delay: str, gap: str, measures: dict[str, Column], watermarked: bool = False) -> DataFrame:
    """Measures of each key's sessions, which end when nothing comes for `gap`; rows out of order join sessions.

    Sessions are merged within each task before the shuffle (run() sees to it), so that a key with a third of all rows
    sends a row a session and task, not all its rows, to the task that holds its state.
    """
    rows = stream if watermarked else _with_watermark(stream, time, delay)
    out = rows.groupBy(F.session_window(time, gap), *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(*keys, F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), *measures)


@dataclass(frozen=True)
class Progress:
    """What a run did: batches, rows read, and rows that came too late and were left out."""

    batches: int
    rows: int
    late: int


MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def run(stream: DataFrame, checkpoint: str, output: str) -> Progress:
    """Appends what a stream gives for all files that its source has now. A later call with the same checkpoint goes on
    where this one ended, or was stopped: offsets and state are those of the last batch that was committed, and the
    output's log leaves out files of batches that were not."""
    spark = stream.sparkSession
    before = spark.conf.get(MERGE_SESSIONS)
    spark.conf.set(MERGE_SESSIONS, "true")
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(MERGE_SESSIONS, before)
    done = query.recentProgress
    late = sum(s.numRowsDroppedByWatermark for p in done for s in p.stateOperators)
    return Progress(len(done), sum(p.numInputRows for p in done), late)
