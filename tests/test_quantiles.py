"""Exact order statistics by selection against plain versions."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.operators import quantiles
from prepweave.operators.aggregate import AggregateConfig, Measure, aggregate_table
from prepweave.operators.quantiles import exact_percentiles
from prepweave.tables import fits_task, numbered_within

FRACTIONS = [0.0, 0.013, 0.25, 0.5, 0.777, 1.0]


def _check(df, rows, buffer):
    got = {r["g"]: tuple(r[1:]) for r in exact_percentiles(df, ["g"], "v", FRACTIONS, buffer).collect()}
    groups = {g for g, _ in rows}
    assert set(got) == groups
    for g in groups:
        values = sorted(float(v) for x, v in rows if x == g and v is not None)
        if not values:
            assert set(got[g]) == {None}
        else:
            assert np.allclose(got[g], np.quantile(values, FRACTIONS), rtol=1e-12), g


@pytest.mark.parametrize("buffer", [3, 40, 5_000])
@pytest.mark.parametrize("kind", ["double", "long", "decimal(18,2)"])
def test_percentiles(kind, buffer, spark):
    r = random.Random(buffer)
    make = {
        "double": lambda: r.choice([0.1, r.gauss(0, 1e9), r.gauss(0, 1e-9), -7.5, float(r.randint(0, 3))]),
        "long": lambda: r.choice([5, 5, 5, r.randint(-(10**15), 10**15), r.randint(0, 9)]),
        "decimal(18,2)": lambda: Decimal(r.choice([100, r.randint(-99999, 99999)])) / 100,
    }[kind]
    rows = [(r.choice(["hot"] * 8 + ["b", None]), None if r.random() < 0.1 else make()) for _ in range(3_000)]
    rows += [("one", make()), ("none", None), ("same", make())]
    rows += [("same", rows[-1][1])] * 90
    _check(spark.createDataFrame(rows, f"g string, v {kind}"), rows, buffer)


def test_rounds_that_do_not_end_are_sorted_by_range(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ROUNDS", 0)
    rows = [("a", float(i * i % 997)) for i in range(1_000)]
    _check(spark.createDataFrame(rows, "g string, v double"), rows, 10)


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert exact_percentiles(none, ["g"], "v", [0.5]).collect() == []
    for groups, fractions in (([], [0.5]), (["g"], []), (["g"], [1.5])):
        with pytest.raises(PlanError):
            exact_percentiles(none, groups, "v", fractions)
    with pytest.raises(PlanError):
        exact_percentiles(none, ["gone"], "v", [0.5])


def test_selection_buffers_no_group(spark):
    """Plans of large groups have sketches, counts and windows over counted values, no percentile of all."""
    df = spark.range(50_000).selectExpr("'a' as g", "cast(id * 7919 % 50021 as double) as v")
    plan = exact_percentiles(df, ["g"], "v", [0.5], 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "left_anti" in plan.lower() or "LeftAnti" in plan
    got = exact_percentiles(df, ["g"], "v", [0.5], 100).collect()
    assert got[0]["p0"] == float(np.median([i * 7919 % 50021 for i in range(50_000)]))


def test_aggregate_medians_and_stages_agree_over_both_ways(spark, monkeypatch, tmp_path):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b", "c", "d"]), None if r.random() < 0.2 else r.randint(0, 50)) for _ in range(500)]
    spark.createDataFrame(rows, "g string, v long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    config = AggregateConfig(["g"], [Measure("v", "median", "m"), Measure("v", "sum", "s"), Measure("v", "median", "mz", "zero")], sort_fields=["s"], percentage_of_total_fields=["s"], rank_field="m", running_total_field="s")
    assert fits_task(df) and not fits_task(df.join(df.withColumnRenamed("v", "w"), "g"), 1 << 10) and not fits_task(df.select(F.explode(F.array("v", "v"))))
    one = aggregate_table(df, config).collect()
    from prepweave.operators import aggregate

    monkeypatch.setattr(aggregate, "fits_task", lambda df: False)
    monkeypatch.setattr(aggregate, "FEW", 0)
    monkeypatch.setattr(quantiles.exact_percentiles, "__defaults__", (20, None))
    assert aggregate_table(df, config).collect() == one and len(one) == 5


def test_numbers_within_groups_over_both_ways(spark, monkeypatch, tmp_path):
    spark.range(2_000).selectExpr("if(id % 3 = 0, 'x', cast(id % 7 as string)) as k", "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    one = sorted(map(tuple, numbered_within(df, "n", ["id"], "k").collect()))
    from prepweave import tables

    monkeypatch.setattr(tables, "fits_task", lambda df: False)
    assert sorted(map(tuple, numbered_within(df, "n", ["id"], "k").select("k", "id", "n").collect())) == one
