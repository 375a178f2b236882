import datetime as dt
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.functions.expressions import Calculation, fld, fn, lit
from prepweave.operators import cleaning
from prepweave.operators.cleaning import Operation, affected_rows, apply_operation, slug
from prepweave.operators.mapping import AlignedSource, AlignmentPlan, Field, Mapping, MappingSet, align_table, alignment_matrix, eligible_sources, with_row_ids
from prepweave.operators.validation import Rule, annotate, findings
from prepweave.plans.drift import MODES, Decision, Expected, Observed, Policy, analyse_drift, repair_mapping
from prepweave.plans.evidence import SHEETS
from prepweave.plans.jobs import JobRunner, recover
from prepweave.plans.plugins import Registry
from prepweave.plans.workflow import WorkflowPlan, assert_no_secrets, compile_workflow, reconcile, run_workflow, upgrade
from prepweave.sources.catalog import fingerprint
from prepweave.sources.xlsx import signature

TODAY = dt.date(2026, 7, 17)


@pytest.mark.parametrize(
    "op,before,after",
    [
        ("text.trim", "  a b\t ", "a b"), ("text.normalise_spaces", " VIKRAM  SEN ", "VIKRAM SEN"), ("text.uppercase", "straße", "STRASSE"), ("text.lowercase", "ÀB", "àb"),
        ("text.proper_case", "o'neil a-b mcx", "O'Neil A-B Mcx"), ("text.remove_non_printable", "a\x00b\t​c\r", "ab\tc"), ("text.normalise_nulls", " N/A ", None), ("text.trim", None, ""),
    ],
)
def test_text_operations(spark, op, before, after):
    df = spark.createDataFrame([(1, before)], "__row_id long, f string")
    assert apply_operation(df, Operation(op, {"field_id": "f"})).first()["f"] == after
    if before is None:
        assert affected_rows(df, Operation(op, {"field_id": "f"})).first()[0] == 1


def test_row_and_field_operations(spark):
    df = spark.createDataFrame([(1, "Code", "Name"), (2, "", None), (3, "x", None)], "__row_id long, a string, b string")
    out = apply_operation(apply_operation(df, Operation("row.remove_blank", {"field_ids": ["a", "b"]})), Operation("row.remove_repeated_headers", {"header_values": {"a": "code", "b": "name"}}))
    assert [r["__row_id"] for r in out.collect()] == [3]
    assert apply_operation(df, Operation("field.rename", {"field_id": "a", "new_field_id": "z"})).columns == ["__row_id", "z", "b"]
    for config, code in (({"field_id": "a", "new_field_id": "b"}, "OPERATION_FIELD_EXISTS"), ({"field_id": "a", "new_field_id": "B c"}, "OPERATION_FIELD_ID_INVALID")):
        with pytest.raises(PlanError, match=code):
            apply_operation(df, Operation("field.rename", config))
    with pytest.raises(PlanError, match="OPERATION_NOT_FOUND"):
        apply_operation(df, Operation("text.reverse", {}))
    with pytest.raises(PlanError, match="OPERATION_VERSION_UNSUPPORTED"):
        apply_operation(df, Operation("text.trim", {"field_id": "a"}, 2))
    assert slug("  Été 2026/Sales ") == "ete_2026_sales" and slug("9x") == "field_9x"


def test_rules(spark):
    df = spark.createDataFrame([(1, " ", "bad", "x"), (2, "ab", "7", "x"), (3, "abc", "1,000", "y")], "__row_id long, name string, n string, u string")
    rules = [
        Rule("1", "required", "name", "REQ"), Rule("2", "data_type", "n", "TYPE", config={"data_type": "integer"}), Rule("3", "unique", "u", "UNIQ", "warning"),
        Rule("4", "allowed_values", "name", "ALLOW", config={"values": ["ab"]}), Rule("5", "min_max", "n", "RANGE", config={"min": 5, "max": 999}),
        Rule("6", "text_length", "name", "LEN", config={"max": 2}), Rule("7", "regex", "name", "RE", config={"pattern": "a|ab"}),
    ]
    got = {(r["row_id"], r["reason_code"]) for r in findings(annotate(df, rules)).collect()}
    assert got == {(1, "REQ"), (1, "TYPE"), (1, "UNIQ"), (2, "UNIQ"), (3, "ALLOW"), (1, "RANGE"), (3, "RANGE"), (3, "LEN"), (3, "RE")}


def _plan():
    fields = (Field("code", "Employee Code"), Field("name", "Full Name"), Field("hours", "Hours", "decimal"))
    maps = MappingSet(fields, (Mapping("code", "Employee Code"), Mapping("name", "Full Name"), Mapping("hours", "Hours")))
    ops = (Operation("text.normalise_spaces", {"field_id": "name"}), Operation("text.proper_case", {"field_id": "name"}))
    calc = Calculation("pay", "pay", "decimal", fn("multiply", fld("hours"), lit(10, "integer")), reason_code="HOURS")
    rules = (Rule("r1", "required", "code", "CODE_MISSING"), Rule("r2", "unique", "code", "CODE_REPEATED"))
    return WorkflowPlan("p", maps, ops, (calc,), rules)


DATA = [(1, "00124", "  anita  rao ", "8"), (2, "00125", "VIKRAM SEN", "9.5"), (3, "00125", "x", "bad"), (4, "", "y", "7")]
SCHEMA = "__row_id long, `Employee Code` string, `Full Name` string, Hours string"


def test_workflow(spark, tmp_path):
    df = spark.createDataFrame(DATA, SCHEMA)
    r = compile_workflow(df, _plan(), TODAY)
    assert [(x["code"], x["name"], float(x["pay"])) for x in r.accepted.collect()] == [("00124", "Anita Rao", 80.0)]
    assert {(x["__row_id"], x["__reason_codes"]) for x in r.rejected.collect()} == {(2, "CODE_REPEATED"), (3, "CODE_REPEATED,HOURS"), (4, "CODE_MISSING")}
    counts = reconcile(r)
    assert counts["read"] == 4 == counts["accepted"] + counts["rejected"] + counts["filtered"] + counts["grouped"]
    r.release()
    run = run_workflow(spark, df, _plan(), str(tmp_path / "o"), TODAY)
    assert run.status == "succeeded" and spark.read.option("header", True).csv(str(tmp_path / "o/accepted")).count() == 1
    assert compile_workflow(df, _plan(), TODAY, limit=2).accepted.count() == 2
    # a source that has changed ends a run; the workbook has seven sheets
    path = str(tmp_path / "source.csv")
    with open(path, "w") as f:
        f.write("a")
    digest = fingerprint(spark, path)
    run = run_workflow(spark, df, _plan(), str(tmp_path / "w"), TODAY, (path, digest), workbook=True)
    book = signature((tmp_path / f"w/p-{run.run_id}.xlsx").read_bytes())
    assert [s[0] for s in book] == list(SHEETS) and {s[0]: s[2] for s in book}["Rejected Rows"] == 4
    with open(path, "a") as f:
        f.write("b")
    with pytest.raises(PlanError, match="SOURCE_CHANGED"):
        run_workflow(spark, df, _plan(), str(tmp_path / "v"), TODAY, (path, digest))


def test_reconciliation(spark, monkeypatch):
    data = [*DATA, (5, "", "", ""), (6, "Employee Code", "b", "c")] + [(10 + i, f"x{i}", "n", "1") for i in range(500)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    plan = replace(_plan(), operations=(Operation("row.remove_blank"), Operation("row.remove_repeated_headers", {"header_values": {"code": "employee code"}}), *_plan().operations))
    r = compile_workflow(df, plan, TODAY)
    r.accepted.head(1)  # a job that reads a part of the rows is no count of them
    counts = reconcile(r)
    r.release()
    assert (counts["read"], counts["filtered"], counts["grouped"], counts["rejected"], counts["accepted"]) == (506, 2, 0, 3, 501)
    grouping = Operation("group.aggregate", {"group_by": ["name"], "aggregates": [{"field_id": "hours", "function": "count", "output_field_id": "n"}]})
    r = compile_workflow(df, WorkflowPlan("p", plan.mapping, (*plan.operations, grouping)), TODAY)
    counts = reconcile(r)
    r.release()
    assert (counts["read"], counts["filtered"], counts["grouped"], counts["accepted"]) == (506, 2, 499, 5)  # five different names
    # a loss that no filter's condition accounts for
    for change in (lambda d, c: d.filter("__row_id <> 2"), lambda d, c: d.unionByName(d.filter("__row_id = 2"))):
        monkeypatch.setitem(cleaning.OPERATIONS, "text.proper_case", change)
        r = compile_workflow(df, plan, TODAY)
        with pytest.raises(PlanError, match="ROW_RECONCILIATION_FAILED"):
            reconcile(r)
        r.release()


def test_row_ids_over_many_ranges(spark, tmp_path):
    """Wide rows, so that adaptive execution cuts other ranges for other plans; each row gets a number of its own, in order."""
    wide = spark.range(40_000).select(F.col("id").alias("k"), *[F.repeat(F.sha2(F.concat_ws("-", "id", F.lit(c)), 256), 8).alias(c) for c in "ab"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        with_row_ids(wide.orderBy(F.rand(1)), ["k"]).write.parquet(str(tmp_path / "t"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = spark.read.parquet(str(tmp_path / "t"))
    assert found.agg(F.count("*"), F.countDistinct("__row_id"), F.count_if(F.col("__row_id") != F.col("k") + 1)).first()[:] == (40_000, 40_000, 0)
    assert with_row_ids(wide.limit(0), ["k"]).count() == 0


def test_plans_hold_no_secrets():
    with pytest.raises(PlanError, match="PLAN_HOLDS_SECRET"):
        assert_no_secrets({"source": [{"db_password": "x"}]})
    assert_no_secrets({"source": {"password": "secret://vault"}})
    assert upgrade({"schema_version": "1.0"})["schema_version"] == "1.2"
    with pytest.raises(PlanError):
        upgrade({"schema_version": "9"})


def test_alignment(spark):
    fields = (Field("k", "Key", "integer", True), Field("v", "", "decimal", aliases=("Value",)), Field("d", data_type="date"))
    maps = MappingSet(fields, (Mapping("k", "Key"), Mapping("v", "gone"), Mapping("d", default_value="2026-01-01")))
    source = AlignedSource("s", maps, "t")
    plan = AlignmentPlan(fields, (source,), extra_field_policy="include")
    cells = {c["field_id"]: c["status"] for c in alignment_matrix({"s": {"Key": "integer", "Value": "decimal", "More!": "text"}}, plan)}
    assert cells == {"k": "mapped", "v": "mapped", "d": "defaulted", "More!": "extra"}
    df = spark.createDataFrame([(1, "7", "1,000.5", "m"), (2, "x", "", None)], "__row_id long, Key string, Value string, `More!` string")
    out = [tuple(r) for r in align_table(df, source, "f.csv", plan).collect()]
    assert out == [(7, 1000.5, dt.date(2026, 1, 1), "m", 1, "s", "f.csv", "t"), (None, None, dt.date(2026, 1, 1), None, 2, "s", "f.csv", "t")]
    bad = alignment_matrix({"s": {"Value": "text"}}, plan)
    with pytest.raises(PlanError, match="SCHEMA_ALIGNMENT_BLOCKED"):
        eligible_sources(bad)


def test_drift_and_repair():
    fields = (Field("employee_code", "Employee Code", required=True), Field("hours", "Hours", "decimal", nullable=False), Field("state", aliases=("Status",)))
    maps = MappingSet(fields, (Mapping("employee_code", "Employee Code"), Mapping("hours", "Hours"), Mapping("state", "STATUS")))
    columns = (("Employee Code", "text"), ("Hours", "decimal"), ("Status", "text"))
    kinds = lambda drift: [f.category for f in drift.findings]
    assert kinds(analyse_drift(Expected(MappingSet(fields, maps.mappings[:2])), Observed(columns))) == []
    assert kinds(analyse_drift(Expected(maps), Observed(columns))) == ["column_renamed"]  # an alias, whatever its case
    same = analyse_drift(Expected(MappingSet(fields, maps.mappings[:2])), Observed(columns[::-1]))
    assert kinds(same) == ["column_reordered"] and same.decision == "review"
    assert [analyse_drift(Expected(maps), Observed(columns[::-1]), Policy(m)).decision for m in MODES] == ["continue", "continue", "review", "stop"]
    moved = analyse_drift(Expected(maps, sheet_name="a", start_row=2), Observed((("Zone", "text"), ("Hours", "text"), ("New", "text"), ("new_2", "text")), "b", (1, 2)))
    assert set(kinds(moved)) == {"sheet_renamed", "header_level_changed", "selected_table_moved", "required_column_removed", "data_type_changed", "optional_column_removed", "column_added", "duplicate_column_introduced"}
    assert moved.decision == "stop"
    known = Expected(maps, approved_synonyms={"employee_code": ("Staff ID",)}, allowed_values={"state": ("open",)})
    found = analyse_drift(known, Observed((("staff id", "text"), ("Hours", "decimal"), ("Status", "text")), null_percentages={"Hours": 5.0}, samples={"Status": ("Open", "lost")}), Policy("auto_accept_safe"))
    assert kinds(found) == ["column_renamed", "nullability_changed", "column_renamed", "new_unexpected_values"]
    assert (found.candidates["employee_code"][0].confidence, found.candidates["employee_code"][0].reason) == (0.92, "approved_synonym")
    assert found.accepted == {"hours": "Hours", "state": "Status"} and found.decision == "continue"  # 0.92 is below the safe threshold
    two = analyse_drift(Expected(maps), Observed((("Employee Code 1", "text"), ("Employee Code 2", "text"), *columns[1:])))
    assert "ambiguous_mapping" in kinds(two) and two.blocked
    with pytest.raises(PlanError, match="DRIFT_MODE_UNSUPPORTED"):
        Policy("report")
    fixed, audit = repair_mapping(maps, [Decision("employee_code", "accept", "Staff ID")])
    assert fixed.version == 2 and fixed.mappings[0].source_column == "Staff ID" and audit[0]["before"] == "Employee Code"
    with pytest.raises(PlanError):
        Decision("x", "manual")


def test_jobs(spark):
    runner = JobRunner(spark)
    ok = runner.submit(lambda job: (job.step("a", 0.5), "succeeded")[1])
    ok.future.result(30)
    assert (ok.state, ok.progress, ok.checkpoints) == ("succeeded", 1.0, ["a"])

    def slow(job):
        for i in range(100):
            job.step(str(i), i / 100)
            time.sleep(0.05)
        return "succeeded"

    job = runner.submit(slow)
    time.sleep(0.3)
    runner.cancel(job.job_id)
    job.future.result(30)
    assert job.state == "cancelled"

    def fails(job):
        raise OSError("disk")

    bad = runner.submit(fails)
    bad.future.result(30)
    assert (bad.state, bad.retryable) == ("failed", True)
    again = runner.retry(bad.job_id, lambda job: "succeeded")
    again.future.result(30)
    assert again.state == "succeeded"
    ok.state = "running"
    assert recover({"x": ok}) == [ok.job_id] and ok.error_code == "ORPHANED_JOB_RECOVERED" and ok.retryable


def test_registry(spark):
    r = Registry()
    r.add("processor", "double", lambda df: df.unionAll(df))
    assert r.process("double", spark.range(2)).count() == 4
    with pytest.raises(PlanError, match="CAPABILITY_DUPLICATE"):
        r.add("processor", "double", print)
