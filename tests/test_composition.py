import hashlib
import json
import zipfile
from dataclasses import replace

import pytest

from prepweave.errors import PlanError
from prepweave.operators.aggregate import AggregateConfig, Measure, aggregate_table
from prepweave.operators.append import AppendConfig, append_tables
from prepweave.operators.joins import JoinConfig, analyse, join_tables
from prepweave.operators.mapping import AlignedSource, AlignmentPlan, Field, Mapping, MappingSet, with_row_ids
from prepweave.operators.reshape import PivotConfig, UnpivotConfig, pivot_table, unpivot_table
from prepweave.operators.split import SplitConfig, safe_name, split_table
from prepweave.plans import composition
from prepweave.plans.composition import CompositionPlan, run_composition
from prepweave.plans.evidence import package, read_manifest, write_split
from prepweave.sources.xlsx import signature


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_append_widens_and_fills(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("z", 2.5)], "k string, w double")
    out = append_tables([a, b]).table
    assert dict(out.dtypes) == {"k": "string", "v": "string", "w": "double"}
    assert rows(out) == [("1", "x", None), ("z", None, 2.5)]


@pytest.mark.parametrize("policy,kept,aside", [("keep_all", 4, 0), ("keep_first", 3, 0), ("keep_last", 3, 0), ("remove_exact", 4, 0), ("reject", 2, 2), ("route_review", 2, 2)])
def test_duplicate_policies(spark, policy, kept, aside):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "k string, v int")
    r = append_tables([df], AppendConfig(duplicate_policy=policy, duplicate_key_fields=["k"]), ["v"])
    assert r.table.count() == kept
    other = r.rejected or r.review
    assert (other.count() if other is not None else 0) == aside
    if policy in ("keep_first", "keep_last"):
        assert {tuple(x) for x in r.table.filter("k is null").collect()} == {(None, 1 if policy == "keep_first" else 2)}


def test_many_to_many_gate(spark):
    left = spark.createDataFrame([(" A ",), ("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a",), ("A",), ("c",)], "k string")
    config = dict(join_type="inner", left_keys=["k"], right_keys=["k"], key_normalisation=["trim", "lowercase"])
    facts = analyse(left, right, JoinConfig(**config)).first()
    assert (facts["cardinality"], facts["estimated_rows"], facts["blocked"]) == ("many_to_many", 4, True)
    with pytest.raises(PlanError, match="JOIN_MANY_TO_MANY_APPROVAL_REQUIRED"):
        join_tables(left, right, JoinConfig(**config))
    r = join_tables(left, right, JoinConfig(**config, approve_many_to_many=True))
    assert r.table.count() == 4 and r.review.count() == 4


@pytest.mark.parametrize("kind,n", [("inner", 1), ("left", 2), ("right", 2), ("full", 3), ("semi", 1), ("anti", 1)])
def test_join_types(spark, kind, n):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int"), spark.createDataFrame([("a", 1), ("c", 2)], "k string, x int")
    out = join_tables(left, right, JoinConfig(kind, ["k"], ["k"])).table
    assert out.count() == n
    assert out.columns == (["k", "x"] if kind in ("semi", "anti") else ["k", "x", "k_right", "x_right"])


def test_null_keys(spark):
    df = spark.createDataFrame([(None,), ("a",)], "k string")
    join = lambda policy: join_tables(df, df, JoinConfig("inner", ["k"], ["k"], null_key_policy=policy))
    assert join("never_match").table.count() == 1
    assert join("match_nulls").table.count() == 2 and join("match_nulls").left_unmatched.count() == 0
    with pytest.raises(PlanError, match="JOIN_NULL_KEYS_REJECTED"):
        join("reject")


def test_aggregate_stages(spark):
    df = spark.createDataFrame([("North", 10), ("North", 20), ("South", 5), (None, None)], "r string, v int")
    out = aggregate_table(df, AggregateConfig(["r"], [Measure("v", "sum", "s"), Measure("v", "unique_count", "u")], ["s"], True, None, ["s"], "s", "rank", "s")).collect()
    assert [(x["r"], x["s"], x["u"], x["rank"], x["running_total"]) for x in out] == [("North", 30, 2, 1, 30), ("South", 5, 1, 2, 35), (None, 0, 1, 3, 35)]
    assert abs(sum(x["s_percentage_of_total"] for x in out) - 100) < 1e-9
    with pytest.raises(PlanError, match="AGGREGATION_NULL_VALUES"):
        aggregate_table(df, AggregateConfig(["r"], [Measure("v", "sum", "s", "error")]))
    with pytest.raises(PlanError, match="AGGREGATION_TYPE_INVALID"):
        aggregate_table(df, AggregateConfig(["v"], [Measure("r", "sum", "s")]))


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([("N", "Jan", 1), ("N", "Feb", 2), ("S", "Jan", 3)], "r string, m string, v int")
    wide = pivot_table(df, PivotConfig(["r"], ["m"], "v"))
    assert wide.columns == ["r", "Feb", "Jan"] and rows(wide) == [("N", 2, 1), ("S", 0, 3)]
    assert unpivot_table(wide, UnpivotConfig(["r"], ["Feb", "Jan"])).count() == 4
    assert pivot_table(df, PivotConfig(["r"], ["m"], "v", "maximum")).filter("Feb is null").count() == 1
    with pytest.raises(PlanError, match="PIVOT_GENERATED_COLUMN_LIMIT"):
        pivot_table(df, PivotConfig(["r"], ["m"], "v", maximum_generated_columns=1))


def test_split(spark):
    df = spark.createDataFrame([(1, "A", "2026-01-03"), (2, "A", "2026-01-09"), (3, "A", "2026-01-10"), (4, None, "x")], "i int, k string, d string")
    out = split_table(df, SplitConfig(["d", "k"], "quarter", 2), ["i"]).orderBy("i").collect()
    assert [(r["__split_key"], r["__chunk"]) for r in out] == [("2026-Q1__A", 1), ("2026-Q1__A", 1), ("2026-Q1__A", 2), ("x__null", 1)]
    taken = set()
    assert [safe_name("{split_value}", {"split_value": v}, taken) for v in ("Finance/North", "Finance\\North", "../x*?", "con", "{y}")] == ["Finance_North", "Finance_North_2", "x", "_con", "{y}"]


def many_ranges(spark, rows: int):
    """Rows whose group 0 holds half of them, and settings under which they are many ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return spark.range(rows).selectExpr("id", "cast(if(id % 2 = 0, 0, id % 7) as int) g", "if(id % 5 = 0, null, id % 11) v")


def test_stages_over_many_ranges(spark):
    try:
        df = many_ranges(spark, 4_000)
        config = AggregateConfig(["id"], [Measure("v", "maximum", "m")], ["m"], True, None, ["m"], "m", "rank", "m")
        found = aggregate_table(df, config).collect()
        values = {i: None if i % 5 == 0 else i % 11 for i in range(4_000)}
        places = {v: n for n, v in enumerate(sorted({v for v in values.values() if v is not None}, reverse=True), 1)}
        order = sorted(values, key=lambda i: (values[i] is not None, -(values[i] or 0), i))
        total, whole = 0, sum(v or 0 for v in values.values())
        assert [r["id"] for r in found] == order
        for r in found:
            v = values[r["id"]]
            total += v or 0
            assert (r["rank"], r["running_total"]) == ((None, None) if v is None else (places[v], total))
            assert r["m_percentage_of_total"] is None if v is None else abs(r["m_percentage_of_total"] - 100 * v / whole) < 1e-9
        chunks = {r["id"]: r["__chunk"] for r in split_table(df, SplitConfig(["g"], maximum_rows_per_file=100), ["id"]).collect()}
        seen: dict[int, int] = {}
        for i in range(4_000):
            g = 0 if i % 2 == 0 else i % 7
            seen[g] = seen.get(g, 0) + 1
            assert chunks[i] == -(-seen[g] // 100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    empty = aggregate_table(df.limit(0), config)
    assert empty.count() == 0 and empty.columns == ["id", "m", "m_percentage_of_total", "rank", "running_total"]
    assert split_table(df.limit(0), SplitConfig(["g"], maximum_rows_per_file=100), ["id"]).count() == 0


def test_join_duplicate_policies(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, x int")
    right = spark.createDataFrame([("a", 7), ("a", 8), ("b", 9)], "k string, x int")
    join = lambda policy, kind="inner": join_tables(left, right, JoinConfig(kind, ["k"], ["k"], duplicate_key_policy=policy), (["x"], ["x"]))
    pairs = lambda r: sorted((x["x"], x["x_right"]) for x in r.table.collect())
    assert pairs(join("keep_first")) == [(1, 7), (5, 9)] and pairs(join("keep_last")) == [(2, 8), (5, 9)]
    assert sorted(x["x"] for x in join("keep_last", "anti").table.collect()) == [4]
    found = join("review").review
    assert sorted((x["__join_side"], x["x"]) for x in found.collect()) == [("left", 1), ("left", 2), ("left", 3), ("left", 4), ("right", 7), ("right", 8)]
    assert "__join_key_0" not in found.columns


def test_row_ids(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "k")
    assert [tuple(r) for r in with_row_ids(df, ["k"]).select("k", "__row_id").orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]


def test_run_composition(spark, tmp_path, monkeypatch):
    fields = (Field("k", data_type="text", required=True), Field("v", data_type="decimal"))
    source = lambda s, col: AlignedSource(s, MappingSet(fields, (Mapping("k", col), Mapping("v", "v"))))
    a = spark.createDataFrame([(1, "x", "1"), (2, "y", "2")], "__row_id long, k string, v string")
    b = spark.createDataFrame([(1, "x", "3")], "__row_id long, kk string, v string")
    plan = CompositionPlan("p", ("a", "b"), AlignmentPlan(fields, (AlignedSource("a", source("a", "k").mapping, user_decisions={"v": "accept"}), AlignedSource("b", source("b", "kk").mapping, user_decisions={"v": "accept"}))), "append", AppendConfig(duplicate_policy="reject", duplicate_key_fields=["k"]), split=SplitConfig(["k"]))
    run = run_composition(spark, {"a": a, "b": b}, plan, str(tmp_path / "out"), "2026-07-17")
    assert run.status == "succeeded" and run.counts["processed"] == 1 and run.counts["rejected"] == 2 and run.counts["dropped_duplicates"] == 0
    assert [e["name"] for e in run.outputs] == ["y"]
    first = run_composition(spark, {"a": a, "b": b}, replace(plan, append=AppendConfig(duplicate_policy="keep_first", duplicate_key_fields=["k"])), str(tmp_path / "first"), "2026-07-17")
    assert (first.counts["processed"], first.counts["dropped_duplicates"]) == (2, 1)
    compose = composition.compose

    def loses(ready, plan):
        result = compose(ready, plan)
        result.rejected = result.rejected.limit(1)
        return result

    monkeypatch.setattr(composition, "compose", loses)
    with pytest.raises(PlanError, match="ROW_RECONCILIATION_FAILED"):
        run_composition(spark, {"a": a, "b": b}, plan, str(tmp_path / "lost"), "2026-07-17")
    assert read_manifest(spark, str(tmp_path / "out"))["run_id"] == run.run_id
    with pytest.raises(PlanError, match="COMPOSITION_SOURCES_INVALID"):
        CompositionPlan("p", ("a", "a"), plan.alignment, "append")


@pytest.mark.parametrize("mode,names", [("csv_files", ["a", "b"]), ("excel_files", ["a.xlsx", "b.xlsx"]), ("excel_sheets", ["p_2026-07-17.xlsx"]), ("zip_package", ["a.csv", "b.csv", "p_2026-07-17.zip"])])
def test_split_modes(spark, tmp_path, mode, names):
    df = spark.createDataFrame([("a", 1, "=x"), ("a", 2, "y"), ("b", 3, "é")], "k string, v int, t string")
    config = SplitConfig(["k"], mode=mode, project_label="p")
    split = split_table(df, config, ["v"])
    out = str(tmp_path / "out")
    entries = write_split(split, config, out, "2026-07-17")
    assert [e.get("file", e["name"]) for e in entries] == names and all(len(e["sha256"]) == 64 for e in entries)
    for e in entries:
        if "file" in e:
            data = (tmp_path / "out" / e["file"]).read_bytes()
            assert hashlib.sha256(data).hexdigest() == e["sha256"] and len(data) == e["bytes"]
    if mode == "csv_files":
        assert sorted(map(tuple, spark.read.option("header", True).csv(out).select("k", "v", "t").collect())) == [("a", "1", "'=x"), ("a", "2", "y"), ("b", "3", "é")]
        return
    if mode == "excel_sheets":
        assert [s[:3] for s in signature((tmp_path / "out" / names[0]).read_bytes())] == [("a", "visible", 3), ("b", "visible", 2)]
    if mode == "zip_package":
        with zipfile.ZipFile(tmp_path / "out" / names[-1]) as z:
            assert z.namelist() == ["a.csv", "b.csv", "output-manifest.json"] and z.read("b.csv").decode("utf-8-sig").split() == ["k,v,t", "b,3,é"]
            assert [e["rows"] for e in json.loads(z.read("output-manifest.json"))] == [2, 1]
    with pytest.raises(PlanError, match="OUTPUT_COLLISION"):
        write_split(split, config, out, "2026-07-17")


def test_package(spark, tmp_path):
    tables = {"t": spark.createDataFrame([(1, "x")], "a int, b string"), "none": spark.createDataFrame([], "a int")}
    one, two = (package(spark, tables, str(tmp_path / f"{i}.zip")) for i in range(2))
    assert one == two == hashlib.sha256((tmp_path / "0.zip").read_bytes()).hexdigest()
    with pytest.raises(PlanError, match="PACKAGE_TOO_LARGE"):
        package(spark, {"t": spark.range(3)}, str(tmp_path / "large.zip"), rows=2)
