"""What a run leaves behind: tables, a manifest, split outputs, packages."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from dataclasses import asdict
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.operators.split import LARGEST_CHUNK, SplitConfig, safe_name, summary

FORMULA = r"^[=+\-@]"
#: Rows that go into spreadsheets' files, which the driver makes.
SHEETS_ROWS = 200_000


def guarded(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run as a formula gets an apostrophe before it."""
    return df.select(*[F.when(F.col(f"`{c}`").rlike(FORMULA), F.concat(F.lit("'"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in df.dtypes])


def write_evidence(tables: dict[str, DataFrame | None], output: str, kind: str = "csv") -> None:
    """Each table below output; existing ones are an error."""
    for name, df in tables.items():
        if df is None:
            continue
        flat = df.select(*[F.to_json(f"`{c}`").alias(c) if k.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, k in df.dtypes])
        (guarded(flat).write.option("header", True).csv if kind == "csv" else flat.write.parquet)(f"{output}/{name}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file in any store that Spark writes to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_manifest(spark: SparkSession, record: Any, output: str) -> None:
    write_text(spark, f"{output}/manifest", json.dumps(asdict(record), sort_keys=True, default=str))


def write_documents(spark: SparkSession, documents: dict[str, Any], output: str) -> None:
    """Small JSON files of exact names, keys sorted."""
    for name, content in documents.items():
        write_bytes(spark, f"{output}/{name}.json", json.dumps(content, indent=2, sort_keys=True, default=str).encode())


def output_manifest(spark: SparkSession, output: str, rows: dict[str, int]) -> list[dict]:
    """An entry for each file below output: path, bytes, SHA-256, and the rows of the table that it belongs to. Files are read
    and hashed by Spark; the manifest itself is written afterwards as output-manifest.json."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(output)
    inside = F.element_at(F.split("path", re.escape(f"/{output.rstrip('/').rpartition('/')[2]}/")), -1)
    found = files.select(inside.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter(~F.col("path").rlike(r"(^|/)[_.]")).orderBy("path").collect()  # a row a file
    entries = [r.asDict() | {"rows": rows.get(r["path"].split("/")[0], 0)} for r in found]
    write_documents(spark, {"output-manifest": entries}, output)
    return entries


def read_manifest(spark: SparkSession, output: str) -> dict:
    return json.loads(spark.read.text(f"{output}/manifest", wholetext=True).first()[0])


def write_split(split: DataFrame, config: SplitConfig, output: str, run_date: str) -> list[dict]:
    """A split's outputs below a folder; returns a manifest entry with rows and SHA-256 for each. Existing ones are an error.

    csv_files: a folder per output, written in one job; the driver names outputs from the summary only. Rows are brought
    together by output and chunk, so each folder has few files, and a chunk is at most the split's largest size. The hash of
    several files is that of their hashes in order. excel_files, excel_sheets and zip_package make spreadsheets' files on the
    driver, and so only up to SHEETS_ROWS rows in all; more is an error, and csv_files the way.
    """
    rows = summary(split).orderBy("__split_key", "__split_group", "__chunk").collect()  # one row an output
    taken: set[str] = set()
    chunks: dict[str, int] = {}
    for r in rows:
        chunks[r["__split_group"]] = max(chunks.get(r["__split_group"], 0), r["__chunk"])
    entries = []
    for r in rows:
        value = r["__split_key"] + (f"_part_{r['__chunk']}" if chunks[r["__split_group"]] > 1 else "")
        name = safe_name(config.naming_template, {"project": config.project_label, "report_type": config.report_type, "split_value": value, "run_date": run_date, "month": value, "department": value}, taken)
        entries.append({"group": r["__split_group"], "chunk": r["__chunk"], "name": name, "rows": r["rows"]})
    if not entries:
        return []
    spark = split.sparkSession
    if config.mode != "csv_files":
        return _write_files(split, config, output, run_date, entries)
    names = spark.createDataFrame([(e["group"], e["chunk"], e["name"]) for e in entries], "__split_group string, __chunk long, __output string")
    named = split.join(F.broadcast(names) if len(entries) <= 100_000 else names, ["__split_group", "__chunk"])
    data = [c for c in split.columns if c not in ("__split_key", "__split_group", "__chunk")]
    guarded(named.select(*data, "__output")).repartition("__output").write.option("header", True).partitionBy("__output").csv(output)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(output)
    hashed = files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "path", F.sha2("content", 256).alias("sha256"), "length").orderBy("path").collect()  # a row a file
    folders: dict[str, list] = {}
    for h in hashed:
        folders.setdefault(unquote(h["folder"]), []).append(h)
    for e in entries:
        own = folders.get(f"__output={e['name']}") or folders.get(f"__output={quote(e['name'])}") or []
        together = hashlib.sha256("".join(h["sha256"] for h in own).encode()).hexdigest()
        e |= {"sha256": own[0]["sha256"] if len(own) == 1 else together, "bytes": sum(h["length"] for h in own)}
    return entries


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file of a bounded size, under its exact name, in any store that Spark writes to; an existing one is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target):
        raise PlanError("OUTPUT_COLLISION", path)
    out = store.create(target, False)
    try:
        out.write(data)
    finally:
        out.close()


def _write_files(split: DataFrame, config: SplitConfig, output: str, run_date: str, entries: list[dict]) -> list[dict]:
    from prepweave.sources.xlsx import write_workbook

    if sum(e["rows"] for e in entries) > SHEETS_ROWS:
        raise PlanError("PACKAGE_TOO_LARGE", f"{SHEETS_ROWS} rows")
    spark, data = split.sparkSession, [c for c in split.columns if c not in ("__split_key", "__split_group", "__chunk")]
    part = lambda e: split.filter((F.col("__split_group") == e["group"]) & (F.col("__chunk") == e["chunk"])).select(*data)
    whole = safe_name("{project}_{run_date}", {"project": config.project_label, "run_date": run_date}, set())
    done = lambda e, name, content: e | {"file": name, "sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content)}
    every = {"group": None, "chunk": None, "name": whole, "rows": sum(e["rows"] for e in entries)}

    def book(tables: dict[str, DataFrame]) -> bytes:
        out = io.BytesIO()
        write_workbook(tables, out)
        return out.getvalue()

    if config.mode == "excel_sheets":
        content = book({e["name"]: part(e) for e in entries})
        write_bytes(spark, f"{output}/{whole}.xlsx", content)
        return [done(every, f"{whole}.xlsx", content)]
    made = []
    for e in entries:
        name, content = (f"{e['name']}.xlsx", book({e["name"]: part(e)})) if config.mode == "excel_files" else (f"{e['name']}.csv", csv_bytes(part(e)))
        write_bytes(spark, f"{output}/{name}", content)
        made.append((done(e, name, content), content))
    found = [e for e, _ in made]
    if config.mode == "zip_package":
        content = zipped({e["file"]: c for e, c in made} | {"output-manifest.json": json.dumps(found, sort_keys=True, indent=2).encode()})
        write_bytes(spark, f"{output}/{whole}.zip", content)
        found.append(done(every, f"{whole}.zip", content))
    return found


def csv_bytes(df: DataFrame) -> bytes:
    """A bounded table as CSV with a byte-order mark, for spreadsheets."""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(df.columns)
    w.writerows(["" if v is None else v for v in r] for r in guarded(df).toLocalIterator())
    return ("\ufeff" + out.getvalue()).encode()


def zipped(files: dict[str, bytes]) -> bytes:
    """An archive in order of names without regard to case; the same files give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files, key=str.casefold):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, files[name])
    return out.getvalue()


def package(spark: SparkSession, tables: dict[str, DataFrame], path: str, rows: int = LARGEST_CHUNK) -> str:
    """A small result as one zip of CSV files and a manifest of their rows and hashes; built on the driver from at most `rows`
    rows of each table, more is an error. Returns the SHA-256 of the archive."""
    files, manifest = {}, []
    for name in sorted(tables):
        n = tables[name].limit(rows + 1).count()
        if n > rows:
            raise PlanError("PACKAGE_TOO_LARGE", name)
        files[f"{name}.csv"] = csv_bytes(tables[name])
        manifest.append({"file": f"{name}.csv", "rows": n, "sha256": hashlib.sha256(files[f"{name}.csv"]).hexdigest()})
    data = zipped(files | {"output-manifest.json": json.dumps(manifest, sort_keys=True, indent=2).encode()})
    write_bytes(spark, path, data)
    return hashlib.sha256(data).hexdigest()


#: The sheets of a workflow's workbook.
SHEETS = ("Processed Data", "Summary", "Validation Errors", "Rejected Rows", "Run Audit", "Source Metadata", "Applied Rules")


def workflow_workbook(spark: SparkSession, result: Any, plan: Any, run: Any, source: tuple[str, str] | None, path: str) -> None:
    """The seven sheets of a workflow run, for results of up to SHEETS_ROWS rows; read again and checked before it is stored."""
    from prepweave.sources.xlsx import sheets_of, write_workbook

    if run.counts["accepted"] + run.counts["rejected"] > SHEETS_ROWS or run.counts["findings"] > SHEETS_ROWS:
        raise PlanError("PACKAGE_TOO_LARGE", f"{SHEETS_ROWS} rows")
    pairs = lambda kind, rows: spark.createDataFrame([(k, str(v)) for k, v in rows], f"{kind} string, Value string")
    place, digest = source or ("", "")
    by_rule = {r["rule_id"]: r["n"] for r in result.findings.groupBy("rule_id").agg(F.count("*").alias("n")).collect()}  # a row a rule
    rules = [("operation", o.operation_id, o.operation_version, None) for o in plan.operations if o.enabled] + [("validation", r.id, 1, by_rule.get(r.id, 0)) for r in plan.rules]
    flat = lambda df: df.select(*[F.to_json(f"`{c}`").alias(c) if k.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, k in df.dtypes])
    tables = {
        "Processed Data": flat(result.accepted),
        "Summary": pairs("Metric", [("Run ID", run.run_id), ("Workflow", plan.project_id), ("Plan version", plan.schema_version), ("Source fingerprint", digest), *((k.replace("_", " ").title(), v) for k, v in run.counts.items())]),
        "Validation Errors": flat(result.findings),
        "Rejected Rows": flat(result.rejected),
        "Run Audit": pairs("Field", [("run_id", run.run_id), ("project_id", plan.project_id), ("source_sha256", digest), ("reconciliation", json.dumps(run.counts, sort_keys=True))]),
        "Source Metadata": pairs("Field", [("path", place), ("sha256", digest)]),
        "Applied Rules": spark.createDataFrame(rules, "Kind string, ID string, Version int, Findings long"),
    }
    out = io.BytesIO()
    write_workbook(tables, out)
    if [s.name for s in sheets_of(out.getvalue())] != list(SHEETS):
        raise PlanError("OUTPUT_VERIFICATION_FAILED", path)
    write_bytes(spark, path, out.getvalue())
