"""As-of and interval joins, fills, shifts, ranks and frames against plain versions, over many small ranges."""

import random

import pytest
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.operators import intervals, ordered
from prepweave.tables import in_ranges


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables stay in as many ranges as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _sorted(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof(strict, forward, how, spark):
    r = random.Random(f"{strict}{forward}")
    key = lambda: r.choice([None, "hot", "hot", "hot", "a", "b"])
    time = lambda: r.choice([None, *range(40)])
    left = [(i, key(), time()) for i in range(150)] + [(900, "a", 5)] * 3
    right = [(key(), time(), r.choice([None, "x", "y"]), r.randint(0, 3)) for _ in range(120)]
    want = []
    for row in left:
        fits = [q for q in right if None not in (row[1], row[2], q[0], q[1]) and row[1] == q[0]]
        fits = [q for q in fits if (q[1] > row[2] if strict else q[1] >= row[2])] if forward else [q for q in fits if (q[1] < row[2] if strict else q[1] <= row[2])]
        fits = [q for q in fits if abs(q[1] - row[2]) <= 9] if forward else fits
        best = max(fits, key=lambda q: (-q[1] if forward else q[1], q[2] is not None, q[2] or "", q[3]), default=None)
        if forward and fits:  # the first time alone decides before the distance
            best = max(fits, key=lambda q: (-q[1], q[2] is not None, q[2] or "", q[3]))
        if best or how == "left":
            want.append((*row, *(best or (None,) * 4)))
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "k string, t long, tag string, n int")
    found = ordered.asof_join(a, b, "t", "t", ["k"], ["k"], how=how, strict=strict, forward=forward, within=F.lit(9) if forward else None)
    assert found.columns == ["id", "k", "t", "k_right", "t_right", "tag", "n"]
    assert _sorted(found.collect()) == _sorted(want)


def test_asof_without_key_and_empty(spark):
    a, none = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id int, t int"), spark.createDataFrame([], "t int, v string")
    b = spark.createDataFrame([(2, "x"), (4, "y")], "t int, v string")
    assert _sorted(ordered.asof_join(a, b, "t", "t").collect()) == _sorted([(1, 5, 4, "y"), (2, None, None, None), (3, 1, None, None)])
    assert _sorted(ordered.asof_join(a, none, "t", "t").collect()) == _sorted([(1, 5, None, None), (2, None, None, None), (3, 1, None, None)])
    assert ordered.asof_join(a.limit(0), b, "t", "t").collect() == []
    with pytest.raises(PlanError) as e:
        ordered.asof_join(a, b, "t", "gone")
    assert e.value.code == "ASOF_JOIN_FIELDS_NOT_FOUND"


def test_hot_key_is_many_ranges(spark):
    rows = spark.range(4_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    sizes = [r["count"] for r in in_ranges(rows, "k", "t").groupBy("__part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 1_500
    plan = ordered.asof_join(rows, rows, "t", "t", ["k"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(k" not in plan


def test_fill_back_reads_a_range_once(spark):
    """A frame up to the last row is read anew for each row: 10 ^ 10 steps for a range of 150,000 rows."""
    df = spark.range(600_000).selectExpr("id", "if(id % 1000 = 999, id, null) as mark")
    filled = ordered.fill(df, ["mark"], ["id"], back=True)
    assert "unboundedfollowing" not in filled._jdf.queryExecution().executedPlan().toString().lower()
    assert filled.filter("mark <> id - id % 1000 + 999 or mark is null").count() == 0


def test_fill_ranks_and_frames(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, 1, 1, 2, 3]), r.choice([None, None, None, i]), r.choice([None, "a", "b"])) for i in range(97)]
    df = spark.createDataFrame(rows, "i int, v int, gap int, k string")
    df.createOrReplaceTempView("ordered_rows")
    filled = ordered.fill(df, ["gap"], ["i"], ["k"])
    want = spark.sql("SELECT i, v, last_value(gap, true) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS gap, k FROM ordered_rows")
    assert _sorted(filled.collect()) == _sorted(want.collect())
    back = ordered.fill(df, ["gap", "k"], ["i"], back=True)
    want = spark.sql("SELECT i, v, first_value(gap, true) OVER w AS gap, first_value(k, true) OVER w AS k FROM ordered_rows WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    assert _sorted(back.collect()) == _sorted(want.collect())
    placed = ordered.positions(in_ranges(df, "v", "i"))
    for n in (1, 5, 13, 97, 200):
        got = ordered.tiles(placed, n, "tile").select("i", "tile")
        assert _sorted(got.collect()) == _sorted(spark.sql(f"SELECT i, ntile({n}) OVER (ORDER BY v, i) FROM ordered_rows").collect())
    got = ordered.ranks(placed, ["v"]).select("i", F.col("rank").cast("int"), F.col("dense_rank").cast("int"), "percent_rank")
    assert _sorted(got.collect()) == _sorted(spark.sql("SELECT i, rank() OVER w, dense_rank() OVER w, percent_rank() OVER w FROM ordered_rows WINDOW w AS (ORDER BY v)").collect())
    for n in (1, -1, 20, -40):  # further than a range is long
        got = ordered.shifted(placed, F.col("gap"), n, "s").select("i", "s")
        assert _sorted(got.collect()) == _sorted(spark.sql(f"SELECT i, lag(gap, {n}) OVER (ORDER BY v, i) FROM ordered_rows").collect())
    got = ordered.range_sums(df, "v", {"n": F.lit(1), "s": F.col("gap")}, 1, 0).select("i", "n", "s")
    want = spark.sql("SELECT i, count(*) OVER w, coalesce(sum(gap) OVER w, 0) FROM ordered_rows WINDOW w AS (ORDER BY v RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)")
    assert _sorted([(a, b, c or 0) for a, b, c in got.collect()]) == _sorted(want.collect())


@pytest.mark.parametrize("seed", range(3))
def test_interval_joins(seed, spark):
    r = random.Random(seed)

    def spans(n):
        out = []
        for i in range(n):
            low = r.choice([None, 7, r.randint(-300, 300)])
            out.append((i, r.choice(["hot", "hot", "b", None]), low, None if low is None or r.random() < 0.05 else low + r.choice([-2, 0, 1, 3, 17, 400])))
        return out

    a, b = spans(90), spans(80)
    left, right = (spark.createDataFrame(x, "i int, k string, lo long, hi long") for x in (a, b))
    good = lambda x: None not in x[2:] and x[2] <= x[3]
    overlap = [(*x, *y) for x in a for y in b if good(x) and good(y) and x[2] <= y[3] and y[2] <= x[3]]
    found = intervals.overlap_join(left, right, ("lo", "hi"), ("lo", "hi"))
    assert found.columns == ["i", "k", "lo", "hi", "i_right", "k_right", "lo_right", "hi_right"] and _sorted(found.collect()) == _sorted(overlap)
    keyed = intervals.overlap_join(left, right, ("lo", "hi"), ("lo", "hi"), (["k"], ["k"]))
    assert _sorted(keyed.collect()) == _sorted([x for x in overlap if x[1] == x[5] and x[1]])
    inside = [(*x, *y) for x in a for y in b if x[2] is not None and good(y) and y[2] <= x[2] <= y[3]]
    assert _sorted(intervals.range_join(left, right, "lo", ("lo", "hi")).collect()) == _sorted(inside)


def test_interval_nodes_are_few_and_apart(spark):
    """A long interval has at most two nodes a level, and its nodes cover each of its bins once."""
    rows = [(0, 0), (0, 1), (-5, 9), (3, 3), (-7, -1), (123, 4567), (-(10**15), 10**15)]
    df = spark.createDataFrame(rows, "lo long, hi long")
    for (lo, hi), nodes in zip(rows, [r["n"] for r in df.select(intervals.nodes(F.col("lo"), F.col("hi"), 0).alias("n")).collect()]):
        covered = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in nodes)
        assert covered[0][0] == lo and covered[-1][1] == hi + 1 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        assert len(nodes) <= 2 * (hi - lo + 1).bit_length()


def test_few_long_intervals_do_not_widen_nodes(spark):
    """Points are copied for the levels that most intervals need, and no node gets a large part of them."""
    spans = spark.range(1400).selectExpr("id as i", "id * 1000 as lo", "id * 1000 + if(id % 700 = 0, 400000, 900) as hi")
    side = spans.selectExpr("lo as __low", "hi as __high")
    bits, highest, tasks = intervals.bins(side)
    assert (bits, highest, tasks) == (10, 0, 1)
    found = [r["n"] for r in side.select(intervals.nodes(F.col("__low"), F.col("__high"), bits, highest).alias("n")).collect()]
    assert {n["level"] for nodes in found for n in nodes} == {0} and sum(map(len, found)) <= 4 * 1400
    assert [n["node"] for n in found[700]] == list(range(700_000 >> 10, (1_100_000 >> 10) + 1))
    long = intervals.bins(spark.range(100).selectExpr("0L as __low", "if(id < 60, 1L, 1L << 40) as __high"))
    assert long[0] == 1 and 37 <= long[1] <= 39
    got = intervals.range_join(spans.selectExpr("lo + 500 as at"), spans, "at", ("lo", "hi")).select("at", "i").collect()
    assert _sorted(got) == _sorted((p * 1000 + 500, i) for p in range(1400) for i in {p, *[x for x in (0, 700) if x <= p and p * 1000 + 500 <= x * 1000 + 400_000]})


def test_pairs_of_copies_make_small_files(spark, tmp_path):
    """A point's pairs stand together, and copies of a point have the same list of intervals."""
    points = spark.range(20_000).selectExpr("id as p", "(id * 7919) % 500 * 100 as at").repartition(3)
    spans = spark.range(20_000).selectExpr("id as i", "(id * 104729) % 500 * 100 as lo", "(id * 104729) % 500 * 100 + 150 as hi").repartition(3)
    pairs = intervals.range_join(points, spans, "at", ("lo", "hi")).select("p", "i")
    pairs.write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n == 20_000 * 80 - 40 * 40 and sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < n


def test_pairs_of_many_copies_make_small_files(spark, tmp_path):
    """Files stay small when a point's list of intervals is as long as a Parquet page; chunks hold each point once."""
    points = spark.range(1_501).selectExpr("id as p", "id % 7 as at").repartition(3)
    spans = spark.range(4_003).selectExpr("id as i", "id % 5 as lo", "id % 5 + 4 as hi").repartition(3)
    intervals.range_join(points, spans, "at", ("lo", "hi")).select("p", "i").write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    want = [(p, i) for p in range(1_501) for i in range(4_003) if i % 5 <= p % 7 <= i % 5 + 4]
    got = found.agg(F.count("*"), F.count_distinct("p", "i"), F.sum(F.expr("p * 5000 + i"))).first()
    assert tuple(got) == (len(want), len(want), sum(p * 5000 + i for p, i in want))
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < len(want) / 4


def test_interval_joins_of_dates_and_nothing(spark):
    days = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01', DATE'2024-01-05'), (2, DATE'2024-01-06', DATE'2024-01-06') t(i, lo, hi)")
    points = spark.sql("SELECT * FROM VALUES (DATE'2024-01-05'), (DATE'2024-01-07'), (NULL) t(d)")
    assert [(r["d"].day, r["i"]) for r in intervals.range_join(points, days, "d", ("lo", "hi")).collect()] == [(5, 1)]
    assert intervals.range_join(points, days.limit(0), "d", ("lo", "hi")).collect() == []
    with pytest.raises(PlanError):
        intervals.range_join(points.withColumn("d", F.lit(1.5)), days, "d", ("lo", "hi"))
    plan = intervals.overlap_join(days, days, ("lo", "hi"), ("lo", "hi"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
