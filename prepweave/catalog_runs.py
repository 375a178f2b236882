"""Queries over what whole runs leave behind; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepweave.operators import mapping
from prepweave.operators.append import AppendConfig
from prepweave.plans.composition import CompositionPlan, run_composition
from prepweave.registry import register, table
from prepweave.streaming.incremental import ingest_new_files
from prepweave.tables import fresh_path


@register(
    """SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, 'customer' AS source, c_custkey AS source_row FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier', s_suppkey FROM supplier"""
)
def composed_partners(spark, sf_dir):
    """Customers and suppliers aligned to one schema and appended by a composition run, as its output holds them."""
    fields = (mapping.Field("key", data_type="integer", required=True), mapping.Field("name"), mapping.Field("nation", data_type="integer"))
    maps = lambda *pairs: mapping.MappingSet(fields, tuple(mapping.Mapping(t, c) for t, c in pairs))
    sources = (
        mapping.AlignedSource("customer", maps(("key", "c_custkey"), ("name", "c_name"), ("nation", "c_nationkey")), "t"),
        mapping.AlignedSource("supplier", maps(("key", "s_suppkey"), ("name", "s_name"), ("nation", "gone")), "t"),
    )
    tables = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("__row_id"), "c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("__row_id"), "s_suppkey", "s_name"),
    }
    out = fresh_path(spark, "composed")
    plan = CompositionPlan("partners", ("customer", "supplier"), mapping.AlignmentPlan(fields, sources), "append", append=AppendConfig())
    run = run_composition(spark, tables, plan, out, "2026-07-17")
    assert run.status == "succeeded" and run.counts["processed"] == run.counts["read"]
    return spark.read.parquet(f"{out}/processed").select("key", "name", F.col("nation").cast("int").alias("nation"), F.col("__source_id").alias("source"), F.col("__source_row").alias("source_row"))


@register("SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS arrival FROM events")
def ingested_events(spark, sf_dir):
    """Files of events that arrive in two portions: the second call reads the new ones only, a third one none."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    folder, checkpoint, out = (fresh_path(spark, n) for n in ("arrivals", "checkpoint", "ingested"))
    counts = []
    for arrival in (0, 1, None):
        if arrival is not None:
            e.filter(F.col("event_id") % 2 == arrival).withColumn("arrival", F.lit(arrival)).write.mode("append").parquet(folder)
        counts.append(ingest_new_files(spark, folder, "event_id long, event_type string, arrival int", checkpoint, out))
    assert counts[2] == 0 and sum(counts) == e.count()
    return spark.read.parquet(out).select("event_id", "event_type", "arrival")
