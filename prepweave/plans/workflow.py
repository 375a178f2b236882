"""A workflow: one source through mapping, cleaning, calculations and rules to accepted and rejected rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.functions.expressions import REASONS, Calculation, apply_calculation
from prepweave.operators import validation
from prepweave.operators.cleaning import GROUPS, KEEPS, ROW_ID, Operation, apply_operation, observed
from prepweave.operators.mapping import MappingSet, apply_mapping
from prepweave.tables import drop, written

SCHEMA_VERSIONS = ("1.0", "1.1", "1.2")
#: Parts of names whose text values would be secrets.
SECRET_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key")


@dataclass(frozen=True)
class WorkflowPlan:
    project_id: str
    mapping: MappingSet
    operations: tuple[Operation, ...] = ()
    calculations: tuple[Calculation, ...] = ()
    rules: tuple[validation.Rule, ...] = ()
    schema_version: str = "1.2"

    def __post_init__(self):
        ids = [o.node_id for o in self.operations if o.node_id]
        if len(ids) != len(set(ids)):
            raise PlanError("OPERATION_NODE_DUPLICATE")
        if self.schema_version not in SCHEMA_VERSIONS:
            raise PlanError("SCHEMA_VERSION_UNSUPPORTED", self.schema_version)


def upgrade(plan: dict) -> dict:
    """An older plan in the newest schema; a newer one than known is an error. Nothing is ever downgraded."""
    version = str(plan.get("schema_version", "1.0"))
    if version not in SCHEMA_VERSIONS:
        raise PlanError("SCHEMA_VERSION_UNSUPPORTED", version)
    out = dict(plan)
    if version < "1.1":
        out.setdefault("calculations", [])
    if version < "1.2":
        out.setdefault("rules", [])
    out["schema_version"] = SCHEMA_VERSIONS[-1]
    return out


def assert_no_secrets(plan, path: str = "plan") -> None:
    """A plan is text that people share, so no field named as a secret may hold a text of its own."""
    if isinstance(plan, dict):
        for k, v in plan.items():
            if isinstance(v, str) and v and not v.startswith("secret://") and any(s in k.lower() for s in SECRET_NAMES):
                raise PlanError("PLAN_HOLDS_SECRET", f"{path}.{k}")
            assert_no_secrets(v, f"{path}.{k}")
    elif isinstance(plan, (list, tuple)):
        for i, v in enumerate(plan):
            assert_no_secrets(v, f"{path}[{i}]")


@dataclass
class WorkflowResult:
    """Tables that all read one annotated table, which is written once below spark.checkpoint.dir and stays until release()."""

    accepted: DataFrame
    rejected: DataFrame
    findings: DataFrame
    annotated: DataFrame
    rows_in: DataFrame
    #: Rows seen on the way: after the mapping, before each operation that removes rows, before and after each grouping.
    seen: list[tuple[str, Observation]] = field(default_factory=list)
    #: The same plan anew, for counts where a job that read a part of the rows was the first.
    again: Callable[[], WorkflowResult] | None = None

    def release(self) -> None:
        drop(self.annotated)


@dataclass
class RunRecord:
    run_id: str
    project_id: str
    status: str
    counts: dict[str, int] = field(default_factory=dict)
    error_code: str | None = None


def compile_workflow(table: DataFrame, plan: WorkflowPlan, today: dt.date, limit: int | None = None) -> WorkflowResult:
    """The plan over a table that has __row_id. A limit applies before the operations, so in a preview uniqueness and
    groups are those of the first rows."""
    source = table.orderBy(ROW_ID).limit(limit) if limit else table
    out, mapped = observed(apply_mapping(source, plan.mapping))
    seen = [("mapping", mapped)]
    for o in plan.operations:
        changes = o.enabled and (o.operation_id in KEEPS or o.operation_id == GROUPS)
        if changes:
            keep = KEEPS[o.operation_id](out, o.config) if o.operation_id in KEEPS else None
            out, before = observed(out, None if keep is None else ~keep)
            seen.append((o.operation_id, before))
        out = apply_operation(out, o)
        if changes and o.operation_id == GROUPS:
            out, after = observed(out)
            seen.append(("grouped", after))
    types = {f.id: f.data_type for f in plan.mapping.fields}
    for o in plan.operations:
        if o.enabled and o.operation_id == "field.rename":
            types[o.config["new_field_id"]] = types.pop(o.config["field_id"], "text")
        if o.enabled and o.operation_id == "group.aggregate":
            types |= {a["output_field_id"]: "integer" if a["function"] == "count" else "decimal" for a in o.config["aggregates"]}
    for c in plan.calculations:
        out = apply_calculation(out, c, types, today)
        types[c.output_canonical_field] = c.output_type
    annotated, left = observed(validation.annotate(out, list(plan.rules)))
    annotated = written(annotated, "annotated")
    seen.append(("the end", left))
    reasons = REASONS if REASONS in annotated.columns else None
    accepted, rejected = validation.split(annotated, reasons)
    return WorkflowResult(accepted, rejected, validation.findings(annotated), annotated, source, seen, lambda: compile_workflow(table, plan, today, limit))


def reconcile(result: WorkflowResult) -> dict[str, int]:
    """Rows read are rows accepted, rejected, filtered or merged into groups, or the run fails.

    Each part is counted on its own: what the source has, what passes each place that may change the number of rows, how many
    rows there the filter's condition drops, and what is left. A row that is lost or repeated anywhere else breaks the sum.
    """
    reasons = REASONS if REASONS in result.annotated.columns else None
    bad = validation.rejecting() | (F.size(reasons) > 0 if reasons else F.lit(False))
    facts = result.annotated.agg(F.count("*").alias("left"), F.count_if(bad).alias("rejected"), F.coalesce(F.sum(F.size(F.filter(validation.FINDINGS, lambda f: f["severity"] == "blocking"))), F.lit(0)).alias("blocking"), F.coalesce(F.sum(F.size(validation.FINDINGS)), F.lit(0)).alias("findings")).first()
    if result.again and result.seen and result.seen[-1][1].get["rows"] != facts["left"]:
        # counts that a repeated task has added to twice: the plan runs anew, and the result is that run's from now on
        fresh = result.again()
        fresh.again = None
        result.release()
        result.__dict__.update(fresh.__dict__)
        return reconcile(result)
    read = expected = result.rows_in.count()
    filtered = grouped = 0
    for name, seen in result.seen:
        rows, dropped = seen.get["rows"], seen.get["dropped"] or 0
        if name == "grouped":
            grouped, expected = grouped + expected - rows, rows
        elif rows != expected:
            raise PlanError("ROW_RECONCILIATION_FAILED", f"{expected} rows before {name}, {rows} there")
        filtered, expected = filtered + dropped, expected - dropped
    counts = {"read": read, "accepted": facts["left"] - facts["rejected"], "rejected": facts["rejected"], "filtered": filtered, "grouped": grouped, "findings": facts["findings"], "blocking": facts["blocking"]}
    if facts["left"] != expected or grouped < 0:
        raise PlanError("ROW_RECONCILIATION_FAILED", str(counts))
    return counts


def _rows_of(spark: SparkSession, path: str) -> int:
    """The records of written delimited files, line breaks within cells aside."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(path).count()


def run_workflow(spark: SparkSession, table: DataFrame, plan: WorkflowPlan, output: str, today: dt.date, source: tuple[str, str] | None = None, workbook: bool = False) -> RunRecord:
    """Runs a plan and writes accepted, rejected and findings below output, with a manifest; a failure writes one too.

    source is the path and the fingerprint of the file behind the table: a file that has changed since ends the run before and
    after its rows are read. workbook adds a spreadsheet of the run, for small results.
    """
    from prepweave.plans.evidence import workflow_workbook, write_evidence, write_manifest
    from prepweave.sources.catalog import assert_unchanged

    run = RunRecord(f"run-{uuid.uuid4().hex[:12]}", plan.project_id, "running")
    try:
        if source:
            assert_unchanged(spark, *source)
        result = compile_workflow(table, plan, today)
        run.counts = reconcile(result)
        if source:
            assert_unchanged(spark, *source)
        write_evidence({"accepted": result.accepted, "rejected": result.rejected, "findings": result.findings}, output)
        left = {k: _rows_of(spark, f"{output}/{k}") for k in ("accepted", "rejected", "findings")}  # what is there now, not what a plan gives again
        if any(left[k] != run.counts[k] for k in left):
            raise PlanError("ROW_RECONCILIATION_FAILED", f"written {left}, counted {run.counts}")
        if workbook:
            workflow_workbook(spark, result, plan, run, source, f"{output}/{plan.project_id}-{run.run_id}.xlsx")
        result.release()
        run.status = "partial" if run.counts["blocking"] else "succeeded"
    except PlanError as e:
        run.status, run.error_code = "failed", e.code
        write_manifest(spark, run, output)
        raise
    write_manifest(spark, run, output)
    return run
