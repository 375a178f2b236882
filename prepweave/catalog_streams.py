"""Queries over streams and kept aggregates; each must agree with the batch SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepweave.registry import register, table
from prepweave.streaming import event_time
from prepweave.streaming.maintained import Kept, Maintained, changes
from prepweave.tables import fresh_path

FILES = 6


def _arrivals(spark, sf_dir, repeats: bool = False):
    """Events as files that come one after another and overlap by hours, every seventh twice if repeats; the last file
    holds one row far in the future, which lets all windows before it end. Gives two folders, for the files that are there
    at first and all of them."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.expr("if(event_id % 3 = 0, 7, user_id)").alias("user_id"))
    span = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    width = (span["hi"] - span["lo"]) / FILES
    late = F.expr("make_dt_interval(0, event_id % 5, 0, 0)")  # a row comes up to four hours after its time
    number = lambda t: F.least(F.floor((t.cast("double") - F.lit(span["lo"]).cast("double")) / width.total_seconds()), F.lit(FILES))
    rows = e.withColumn("file", number(F.col("ts") + late))
    if repeats:
        rows = rows.unionByName(e.filter("event_id % 7 = 0").withColumn("file", number(F.col("ts") + F.expr("interval 3 hours"))))
    end = e.limit(1).withColumn("ts", F.lit(span["hi"]) + F.expr("interval 30 days")).withColumn("user_id", F.lit(-1).cast("long")).withColumn("event_id", F.lit(-1).cast("long")).withColumn("file", F.lit(FILES + 1).cast("long"))
    folder = fresh_path(spark, "arrivals")
    rows = rows.unionByName(end).persist()
    try:
        for i in range(FILES + 2):  # a file after the other, as streams read them by their time
            rows.filter(F.col("file") == i).drop("file").repartition(1, "user_id").sortWithinPartitions(F.hash("event_id")).write.mode("append").parquet(folder)
            if i == FILES // 2:
                yield folder
    finally:
        rows.unpersist()
    yield folder


def _in_two_runs(spark, sf_dir, make, repeats: bool = False):
    """What a stream gives that is stopped after half of the files and started again from its checkpoint."""
    checkpoint, output = fresh_path(spark, "checkpoint"), fresh_path(spark, "stream")
    schema = "event_id long, ts timestamp, event_type string, user_id long"
    for folder in _arrivals(spark, sf_dir, repeats):
        progress = event_time.run(make(event_time.replay(spark, folder, schema, files_at_once=2)), checkpoint, output)
        assert progress.late == 0, "rows came later than the delay"
    out = spark.read.parquet(output)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})


ARRIVED = "SELECT event_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id FROM events"


@register(
    f"""WITH e AS ({ARRIVED}), b AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM b)
SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS events, max(event_id) AS last_event FROM s GROUP BY user_id, session"""
)
def stream_sessions(spark, sf_dir):
    """Users' sessions of events that come out of order, in two runs; one user has a third of all events."""
    measures = {"events": F.count("*"), "last_event": F.max("event_id")}
    return _in_two_runs(spark, sf_dir, lambda s: event_time.sessions(s, ["user_id"], "ts", "6 hours", "30 minutes", measures)).filter("user_id <> -1")


@register(f"WITH e AS ({ARRIVED}) SELECT event_type, date_trunc('hour', ts) AS since, count(*) AS events, count(DISTINCT user_id) AS users FROM e GROUP BY 1, 2")
def stream_hourly_without_repeats(spark, sf_dir):
    """Events an hour and type, each counted once though every seventh comes twice; in two runs."""

    def make(stream):
        once = event_time.deduplicated(stream, ["event_id"], "ts", "6 hours")
        return event_time.windowed(once, ["event_type"], "ts", "6 hours", "1 hour", {"events": F.count("*"), "users": F.size(F.collect_set("user_id")).cast("long")}, watermarked=True)

    return _in_two_runs(spark, sf_dir, make, repeats=True).filter("since < timestamp_ntz'2024-02-15 00:00:00'").drop("until")


@register(
    """WITH o AS (SELECT o_orderkey, o_custkey % 40 AS customer, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CAST(CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice * 2 ELSE o_totalprice END AS DECIMAL(18,2)) AS price FROM orders WHERE o_orderkey % 10 <> 7 AND o_custkey % 40 <> 5)
SELECT customer, priority, count(*) AS orders, CAST(sum(price) AS DOUBLE) AS revenue, CAST(min(price) AS DOUBLE) AS lowest, CAST(max(price) AS DOUBLE) AS highest, count(DISTINCT price) AS prices FROM o GROUP BY 1, 2"""
)
def maintained_orders(spark, sf_dir):
    """An aggregate kept over three batches: a first load, changed prices with new rows, and deleted rows and groups."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 40 as customer", "if(o_orderkey % 11 = 0, null, o_orderpriority) as priority", "cast(o_totalprice as decimal(18,2)) as price")
    first = o.filter("o_orderkey % 3 <> 0")
    second = o.selectExpr("o_orderkey", "customer", "priority", "cast(if(o_orderkey % 4 = 1, price * 2, price) as decimal(18,2)) as price")
    third = second.filter("o_orderkey % 10 <> 7 and customer <> 5")
    kept = Maintained(spark, fresh_path(spark, "maintained"), ["customer", "priority"], [Kept("count", "", "orders"), Kept("sum", "price", "revenue"), Kept("minimum", "price", "lowest"), Kept("maximum", "price", "highest"), Kept("unique_count", "price", "prices")])
    kept.apply(first.withColumn("__sign", F.lit(1)), 1)
    kept.apply(changes(first, second, ["o_orderkey"]), 2)
    kept.apply(changes(second, third, ["o_orderkey"]), 3)
    return kept.result().select("customer", "priority", "orders", *[F.col(c).cast("double").alias(c) for c in ("revenue", "lowest", "highest")], "prices")
