"""Event-time streams and kept aggregates against plain versions."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.streaming import event_time
from prepweave.streaming.maintained import Kept, Maintained, changes

SCHEMA = "id long, ts timestamp, k string"
START = dt.datetime(2024, 1, 1)


def _put(spark, folder, rows):
    spark.createDataFrame([(i, START + dt.timedelta(minutes=m), k) for i, m, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_sessions_join_out_of_order_rows_over_a_restart(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    make = lambda: event_time.sessions(event_time.replay(spark, folder, SCHEMA), ["k"], "ts", "1 hour", "10 minutes", {"n": F.count("*"), "ids": F.sum("id")})
    _put(spark, folder, [(1, 0, "a"), (2, 18, "a"), (3, 5, "b"), (4, 3, None)])
    first = event_time.run(make(), checkpoint, out)
    _put(spark, folder, [(5, 9, "a"), (6, 200, "a")])  # joins the two sessions of a
    _put(spark, folder, [(9, 205, "c")])
    _put(spark, folder, [(7, 100, "b"), (8, 2000, "end")])  # 100 lies before the watermark of 140
    second = event_time.run(make(), checkpoint, out)
    got = sorted((r["k"] or "", int((r["since"] - START).total_seconds() // 60), int((r["until"] - START).total_seconds() // 60), r["n"], r["ids"]) for r in spark.read.parquet(out).collect())
    assert got == [("", 3, 13, 1, 4), ("a", 0, 28, 3, 8), ("a", 200, 210, 1, 6), ("b", 5, 15, 1, 3), ("c", 205, 215, 1, 9)]
    assert (first.rows, first.late, second.rows, second.late) == (4, 0, 5, 1)
    again = event_time.run(make(), checkpoint, out)  # nothing new
    assert again.rows == 0 and spark.read.parquet(out).count() == 5


def test_repeats_are_dropped_within_the_delay(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    _put(spark, folder, [(1, 0, "a"), (1, 1, "a"), (2, 2, "a"), (None, 3, "a"), (None, 4, "b")])
    _put(spark, folder, [(1, 20, "a"), (3, 30, "b")])
    event_time.run(event_time.deduplicated(event_time.replay(spark, folder, SCHEMA), ["id"], "ts", "1 hour"), checkpoint, out)
    assert sorted(r["id"] or 0 for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    with pytest.raises(PlanError):
        event_time.deduplicated(event_time.replay(spark, folder, SCHEMA), ["id"], "gone", "1 hour")


MEASURES = [Kept("count", "", "n"), Kept("count", "v", "known"), Kept("sum", "v", "total"), Kept("average", "v", "mean"), Kept("minimum", "v", "low"), Kept("maximum", "v", "high"), Kept("unique_count", "v", "kinds")]


def _wanted(rows):
    groups = defaultdict(list)
    for _, g, v in rows:
        groups[g].append(v)
    out = {}
    for g, values in groups.items():
        known = [v for v in values if v is not None]
        out[g] = (len(values), len(known), sum(known), round(sum(known) / len(known), 4) if known else None, min(known, default=None), max(known, default=None), len(set(known)))
    return out


def _got(df):
    number = lambda v: None if v is None else float(v)
    return {r["g"]: (r["n"], r["known"], number(r["total"]), None if r["mean"] is None else round(float(r["mean"]), 4), r["low"], r["high"], r["kinds"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_maintained_equals_from_scratch(seed, spark, tmp_path):
    r = random.Random(seed)
    table = {}
    kept = Maintained(spark, str(tmp_path / "m"), ["g"], MEASURES)
    frame = lambda t: spark.createDataFrame([(i, *x) for i, x in t.items()], "id int, g string, v double")
    for batch in range(4):
        new = dict(table)
        for _ in range(25):
            i = r.randrange(40)
            if r.random() < 0.3:
                new.pop(i, None)
            else:
                new[i] = (r.choice([None, "hot", "hot", "hot", "a", "b"]), r.choice([None, 0.1, 0.25, 0.25, 7.5, -3.0]))
        delta = changes(frame(table), frame(new), ["id"])
        kept.apply(delta, batch)
        if batch == 1:
            kept.apply(delta, batch)  # once more after a failure
        rows = [(i, *x) for i, x in new.items()]
        assert _got(kept.result()) == {k: v for k, v in _wanted(rows).items()}
        gone = {table[i][0] for i in table if table[i] != new.get(i)} | {new[i][0] for i in new if new[i] != table.get(i)}
        assert {x["g"] for x in kept.touched(batch).collect()} <= gone
        table = new
    small = kept.compact(str(tmp_path / "c"))
    assert _got(small.result()) == _got(kept.result())
    small.apply(frame(table).withColumn("__sign", F.lit(-1)), 1)
    assert small.result().collect() == []


def test_maintained_only_writes_what_is_touched(spark, tmp_path):
    kept = Maintained(spark, str(tmp_path / "m"), ["g"], MEASURES[:3])
    kept.apply(spark.range(1000).selectExpr("cast(id % 100 as string) as g", "1.5 as v", "1 as __sign"), 0)
    kept.apply(spark.createDataFrame([("7", 1.5, -1), ("7", 2.0, 1), ("9", 1.0, 1), ("9", 1.0, -1)], "g string, v double, __sign int"), 1)
    assert [x["g"] for x in kept.touched(1).collect()] == ["7"]
    assert kept.result().filter("g = '7'").collect()[0]["total"] == 15.5
    for bad in ([], [Kept("median", "v", "x")]):
        with pytest.raises(PlanError):
            Maintained(spark, "x", ["g"], bad)
    with pytest.raises(PlanError):
        kept.apply(spark.range(1), 2)
    with pytest.raises(PlanError):
        Maintained(spark, str(tmp_path / "none"), ["g"], MEASURES).result()
