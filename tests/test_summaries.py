"""Cubes against Spark's own, sketches against one pass and exact counts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prepweave import catalog
from prepweave.errors import PlanError
from prepweave.operators import sketches
from prepweave.operators.aggregate import Measure
from prepweave.operators.cube import cube, grouping_sets, rollup

MEASURES = [Measure("v", "count", "n"), Measure("v", "sum", "s"), Measure("v", "average", "m"), Measure("v", "minimum", "lo"), Measure("w", "maximum", "hi"), Measure("w", "unique_count", "kinds")]


def _sorted(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = [(r.choice([None, "a", "b"]), r.choice([None, 1, 2, 3]), r.choice(["x", "y"]), r.choice([None, *range(9)]), r.choice([None, "p", "q", "r"])) for _ in range(300)]
    df = spark.createDataFrame(data, "a string, b int, c string, v long, w string")
    df.createOrReplaceTempView("cube_rows")
    return df


@pytest.mark.parametrize("many", [0, 10**6])
def test_cube_and_sets(rows, spark, many):
    columns = "grouping_id() AS g, count(v), coalesce(sum(v), 0), avg(v), min(v), max(w), count(DISTINCT w) + max(if(w IS NULL, 1, 0))"
    for sets, sql in ((cube(["a", "b", "c"]), "CUBE (a, b, c)"), (rollup(["a", "b", "c"]), "ROLLUP (a, b, c)"), ([["a", "b", "c"], ["b"], ["c", "a"], ["b"]], "GROUPING SETS ((a, b, c), (b), (a, c))")):
        found = grouping_sets(rows, sets, MEASURES, many)
        assert found.columns == ["a", "b", "c", "grouping_id", "n", "s", "m", "lo", "hi", "kinds"]
        assert _sorted(found.collect()) == _sorted(spark.sql(f"SELECT a, b, c, {columns} FROM cube_rows GROUP BY {sql}").collect()), sql


def test_cube_of_nothing_and_errors(rows):
    assert [tuple(r) for r in grouping_sets(rows.limit(0), cube(["a"]), MEASURES).collect()] == [(None, 1, 0, 0, None, None, None, 0)]
    plan = grouping_sets(rows, cube(["a", "b", "c"]), MEASURES)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    for sets, measures, code in (([], MEASURES, "GROUPING_SETS_INVALID"), (cube(["a"]), [Measure("v", "median", "x")], "GROUPING_SETS_INVALID"), (cube(["z"]), MEASURES, "AGGREGATION_FIELDS_NOT_FOUND"), (cube(["a"]), [Measure("w", "sum", "x")], "AGGREGATION_TYPE_INVALID")):
        with pytest.raises(PlanError) as e:
            grouping_sets(rows, sets, measures)
        assert e.value.code == code


def _parts(df):
    return [df.filter(f"id % 5 = {i}") for i in range(5)] + [df.limit(0)]


def _merged(make, merge, df):
    parts = [make(p) for p in _parts(df)]
    two = merge(parts[0].unionByName(parts[1]).unionByName(parts[5]))
    return merge(two.unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]))


@pytest.mark.parametrize("n", [0, 1, 100, 3_000, 120_000])
def test_distinct_sketches(n, spark):
    df = spark.range(n).selectExpr("id", "if(id % 2 = 0, 'g', null) as g", "if(id % 11 = 0, null, id div 2 * 31) as v")
    one = sketches.distinct_sketch(df, ["g"], "v")
    merged = _merged(lambda p: sketches.distinct_sketch(p, ["g"], "v"), lambda s: sketches.merge_distinct(s, ["g"]), df)
    assert _sorted(merged.collect()) == _sorted(one.collect())
    exact = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count_distinct("v").alias("n")).collect() if r["n"]}
    got = {r["g"]: r["n"] for r in one.select("g", sketches.distinct_estimate(F.col("sketch")).alias("n")).collect()}
    assert set(got) == set(exact) and all(abs(got[g] - exact[g]) <= 4 * 1.04 / math.sqrt(sketches.REGISTERS) * exact[g] + 0.5 for g in exact)


def test_quantile_sketches(spark):
    r = random.Random(2)
    values = [0.0, 0.0, -1e-12, 5e300, *[r.choice([r.gauss(0, 1e6), r.random(), -r.expovariate(1)]) for _ in range(4_000)]]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(9, None), (8, float("nan")), (7, float("inf"))], "id long, v double")
    one = sketches.quantile_sketch(df, [], "v")
    merged = _merged(lambda p: sketches.quantile_sketch(p, [], "v"), lambda s: sketches.merge_quantiles(s, []), df)
    assert merged.collect() == one.collect()
    fractions = [0, 0.001, 0.1, 0.5, 0.9, 0.9999, 1]
    got, values = sketches.quantile_estimates(merged, [], fractions).first(), sorted(values)
    for p, about in zip(fractions, got):
        exact = values[int(p * (len(values) - 1))]
        assert abs(about - exact) <= sketches.RELATIVE * abs(exact) * 1.000001, p


def test_frequency_sketches(spark):
    r = random.Random(5)
    items = ["hot"] * 900 + ["warm"] * 300 + ["", "ü"] * 150 + [f"rare {i}" for i in range(1_500)]
    r.shuffle(items)
    data = [(i, "all", x) for i, x in enumerate(items)] + [(i, None, "only") for i in range(10)] + [(0, "all", None)]
    df = spark.createDataFrame(data, "id long, g string, v string")
    one = sketches.frequency_sketch(df, ["g"], "v", 0.04)
    merged = _merged(lambda p: sketches.frequency_sketch(p, ["g"], "v", 0.04), lambda s: sketches.merge_frequencies(s, ["g"], 0.04), df)
    assert _sorted(merged.select("g", "sketch", "n", "heavy").collect()) == _sorted(one.select("g", "sketch", "n", "heavy").collect())
    counts = Counter(items)
    got = {(r["g"], r["value"]): (r["about"], r["n"]) for r in sketches.heavy_hitters(merged, ["g"]).collect()}
    assert set(got) == {("all", x) for x, c in counts.items() if c >= 0.04 * len(items)} | {(None, "only")}
    assert all(counts[x] <= about <= counts[x] + 2.72 * n / sketches.CELLS + 1 for (g, x), (about, n) in got.items() if g)
    with pytest.raises(PlanError):
        sketches.distinct_sketch(df, ["gone"], "v")


def test_quantiles_are_checked_without_a_buffer_of_all_values(spark):
    plan = catalog.queries()["sketch_quantiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile_disc" not in plan and "percentiledisc" not in plan
