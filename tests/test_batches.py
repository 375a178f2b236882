"""Batch catalogue, profiles, previews, managed copies, names, and counts of what was written."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.operators import validation
from prepweave.operators.joins import JoinConfig, join_tables
from prepweave.operators.mapping import Field, Mapping, MappingSet
from prepweave.operators.split import clean_name, safe_name
from prepweave.plans import workflow
from prepweave.sources import discovery
from prepweave.sources.catalog import FolderConfig, build_catalog, fingerprint, import_source, scan_folder
from prepweave.sources.grid import read_grid


def test_batch_catalog(spark, tmp_path):
    for name, text in {"a.csv": "Code,Hours\n007,8\n008,9.5\nGrand Total,17.5\n", "b.csv": "Code,Hours\n007,8\n008,9.5\nGrand Total,17.5\n", "c.csv": "Item,Qty\nA,1\n\nOther,Thing,More\n1,2,3\n4,5,6\n", "d.csv": "\n,\n", "e.xlsx": "no workbook", "f.csv": "x,y\n1,2\n"}.items():
        (tmp_path / name).write_text(text)
    scanned = scan_folder(spark, FolderConfig(str(tmp_path)))
    known = scanned.filter("relative_path = 'f.csv'")
    found = {r["relative_path"]: r for r in build_catalog(spark, scanned, known, "largest").collect()}
    assert {k: r["state"] for k, r in found.items()} == {"a.csv": "eligible", "b.csv": "duplicate", "c.csv": "eligible", "d.csv": "quarantined", "e.xlsx": "quarantined", "f.csv": "unchanged"}
    assert (found["a.csv"]["rows"], [tuple(c) for c in found["a.csv"]["columns"]]) == (2, [("Code", "text"), ("Hours", "decimal")])
    assert found["c.csv"]["table_id"] == "r4-6c1-3" and found["c.csv"]["rows"] == 2
    assert found["d.csv"]["reason"] == "TABLE_NOT_FOUND" and found["e.xlsx"]["reason"] and found["a.csv"]["warnings"]


def test_assembled_table(spark, tmp_path):
    text = "Emp ID,Rate %,Note\n" + "".join(f"0{i},{i}%,n{i % 3}\n" for i in range(1, 9)) + "Emp ID,Rate %,Note\nPrinted by me,,\n"
    (tmp_path / "t.csv").write_text(text)
    grid = read_grid(spark, str(tmp_path / "t.csv"))
    found = discovery.assemble(grid, discovery.choose(discovery.discover(grid)), discovery.Overrides(preview_rows=2, profile_sample_rows=4))
    assert (found.rows, found.repeated_headers, found.footers) == (8, 1, 1) and len(found.warnings) >= 2
    assert found.preview == [{"Emp ID": "01", "Rate %": "1%", "Note": "n1"}, {"Emp ID": "02", "Rate %": "2%", "Note": "n2"}]
    by = {c["column"]: c for c in found.columns}
    assert by["Emp ID"]["identifier_candidate"] and by["Emp ID"]["roles"] == ["identifier"] and "percentage" in by["Rate %"]["roles"]
    assert by["Note"]["samples"] == ["n1", "n2", "n0"] and by["Rate %"]["samples"] == ["1%", "2%", "3%", "4%"] and by["Note"]["unique_count"] == 3


def test_managed_copy(spark, tmp_path):
    (tmp_path / "my file (1).CSV").write_text("a,b\n1,2\n")
    given = str(tmp_path / "my file (1).CSV")
    copy, digest = import_source(spark, given, str(tmp_path / "managed"))
    assert copy.endswith("/my_file_1.csv") and digest == fingerprint(spark, given) and (tmp_path / "my file (1).CSV").exists()
    again, _ = import_source(spark, given, str(tmp_path / "managed"))
    assert again != copy
    for bad, code in ((str(tmp_path / "x.pdf"), "SOURCE_UNSUPPORTED_TYPE"), (str(tmp_path / "gone.csv"), "SOURCE_NOT_FOUND")):
        with pytest.raises(PlanError) as e:
            import_source(spark, bad, str(tmp_path / "managed"))
        assert e.value.code == code


def test_names():
    assert [clean_name(x) for x in ("con", "a..b", " .x. ", "a/b\\c", "", "LPT1")] == ["_con", "a_b", "x", "a_b_c", "output", "_LPT1"]
    assert clean_name("x" * 178 + " . y") == "x" * 178
    taken: set[str] = set()
    values = {"split_value": "a/..b", "month": "2024-01"}
    assert [safe_name("{month}-{split_value}{none}", values, taken) for _ in range(2)] == ["2024-01-a_b", "2024-01-a_b_2"] or taken


def test_declared_unique_side_skips_the_gate(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    with pytest.raises(PlanError):
        join_tables(a, b, JoinConfig("inner", ["k"], ["k"]))
    read = b.filter("w = 'p'").withColumn("w", F.when(F.col("w") == "p", F.col("w")).otherwise(F.raise_error(F.lit("the gate read a row"))))
    assert join_tables(a, read, JoinConfig("inner", ["k"], ["k"], unique_side="right")).table.count() == 2
    with pytest.raises(PlanError):
        JoinConfig("inner", ["k"], ["k"], unique_side="both")


def test_unique_rule_of_a_hot_value(spark):
    df = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 3 else f"v{i}") for i in range(200)] + [(500, " ")], "__row_id long, v string")
    found = validation.findings(validation.annotate(df, [validation.Rule("r", "unique", "v", "TWICE"), validation.Rule("q", "required", "v", "NONE")]))
    codes = [(r["reason_code"], r["original_value"]) for r in found.collect()]
    assert codes.count(("TWICE", "hot")) == 100 and {c for c in codes if c[0] == "TWICE"} == {("TWICE", "hot")} and sum(c[0] == "NONE" for c in codes) == 66 + 1
    plan = validation.annotate(df, [validation.Rule("r", "unique", "v", "TWICE")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_lost_written_rows_fail_the_run(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([(i, f"line\n{i}, \"q\"" if i % 7 else "") for i in range(1, 60)], "__row_id long, name string")
    plan = workflow.WorkflowPlan("p", MappingSet((Field("name"),), (Mapping("name", "name"),)), rules=(validation.Rule("r", "required", "name", "NO_NAME"),))
    run = workflow.run_workflow(spark, table, plan, str(tmp_path / "good"), dt.date(2026, 1, 1))
    assert (run.counts["accepted"], run.counts["rejected"], run.counts["findings"]) == (51, 8, 8)
    from prepweave.plans import evidence

    whole = evidence.write_evidence
    monkeypatch.setattr(evidence, "write_evidence", lambda tables, output, kind="csv": whole(tables | {"accepted": tables["accepted"].limit(50)}, output, kind))
    with pytest.raises(PlanError) as e:
        workflow.run_workflow(spark, table, plan, str(tmp_path / "bad"), dt.date(2026, 1, 1))
    assert e.value.code == "ROW_RECONCILIATION_FAILED"


def test_run_folder_holds_what_is_written_on_the_way(spark, tmp_path):
    from prepweave.operators.ordered import fill
    from prepweave.tables import RUN, run_folder

    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "i int, v string")
    with run_folder(spark) as outer:
        fill(df, ["v"], ["i"]).write.parquet(str(tmp_path / "filled"))
        with run_folder(spark) as inner:
            assert inner.startswith(outer) and spark.conf.get(RUN) == inner
        path = spark._jvm.org.apache.hadoop.fs.Path(outer)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert store.exists(path)
    assert not store.exists(path) and spark.conf.get(RUN, None) is None
    assert sorted((r["i"], r["v"]) for r in spark.read.parquet(str(tmp_path / "filled")).collect() if r["v"]) == [(2, "x"), (3, "x")]


def test_composition_leaves_its_documents(spark, tmp_path):
    import hashlib
    import json
    import os

    from prepweave.operators.append import AppendConfig
    from prepweave.operators.mapping import AlignedSource, AlignmentPlan
    from prepweave.plans.composition import CompositionPlan, run_composition

    fields = (Field("k", data_type="integer", required=True),)
    maps = MappingSet(fields, (Mapping("k", "k"),))
    tables = {s: spark.createDataFrame([(i, i) for i in range(5)], "__row_id long, k long") for s in "ab"}
    plan = CompositionPlan("p", ["a", "b"], AlignmentPlan(fields, tuple(AlignedSource(s, maps, "t") for s in "ab")), "append", append=AppendConfig())
    out = str(tmp_path / "out")
    run = run_composition(spark, tables, plan, out, "2026-07-17")
    names = {f[:-5] for f in os.listdir(out) if f.endswith(".json")}
    assert names == {"applied-plan", "schema-alignment", "source-manifest", "rejected-files", "batch-summary", "audit-log", "output-manifest"}
    read = lambda n: json.load(open(f"{out}/{n}.json"))
    assert read("batch-summary")["counts"] == run.counts and read("applied-plan")["operation"] == "append" and len(read("schema-alignment")) == 2
    entries = read("output-manifest")
    assert {e["path"].split("/")[0] for e in entries} >= {"processed", "alignment", "applied-plan.json"}
    for e in entries:
        data = open(f"{out}/{e['path']}", "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (e["bytes"], e["sha256"])
    assert {e["rows"] for e in entries if e["path"].startswith("processed/")} == {10}
