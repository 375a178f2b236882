"""A composition: several sources aligned to one schema, then exactly one operation, then perhaps a split."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from prepweave.errors import PlanError
from prepweave.operators.aggregate import AggregateConfig, aggregate_table
from prepweave.operators.append import AppendConfig, Result, append_tables
from prepweave.operators.joins import JoinConfig, join_tables
from prepweave.operators.mapping import AlignmentPlan, align_table, alignment_matrix, eligible_sources
from prepweave.operators.reshape import PivotConfig, UnpivotConfig, pivot_table, unpivot_table
from prepweave.operators.split import SplitConfig, canonical_types, split_table

OPERATIONS = ("append", "union", "join", "aggregate", "pivot", "unpivot")


@dataclass(frozen=True)
class CompositionPlan:
    project_id: str
    source_ids: tuple[str, ...]
    alignment: AlignmentPlan
    operation: str
    append: AppendConfig | None = None
    join: JoinConfig | None = None
    join_inputs: tuple[str, str] | None = None
    aggregate: AggregateConfig | None = None
    pivot: PivotConfig | None = None
    unpivot: UnpivotConfig | None = None
    split: SplitConfig | None = None

    def __post_init__(self):
        if self.operation not in OPERATIONS:
            raise PlanError("COMPOSITION_OPERATION_UNSUPPORTED", self.operation)
        if len(set(self.source_ids)) != len(self.source_ids) or not self.source_ids:
            raise PlanError("COMPOSITION_SOURCES_INVALID")
        if {s.source_id for s in self.alignment.sources} != set(self.source_ids):
            raise PlanError("COMPOSITION_ALIGNMENT_MISMATCH")
        if self.operation in ("join", "aggregate", "pivot", "unpivot") and getattr(self, self.operation) is None:
            raise PlanError("COMPOSITION_CONFIG_REQUIRED", self.operation)
        if self.operation == "join" and (self.join_inputs is None or not set(self.join_inputs) <= set(self.source_ids)):
            raise PlanError("COMPOSITION_JOIN_INPUTS_INVALID")


def aligned(tables: dict[str, DataFrame], plan: CompositionPlan, filenames: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], list[dict]]:
    """The eligible sources in the plan's order, and the alignment matrix. Column types come from the tables' schemas."""
    observed = {s: {c: k for c, k in canonical_types(t).items() if not c.startswith("__")} for s, t in tables.items()}
    cells = alignment_matrix(observed, plan.alignment)
    ok = set(eligible_sources(cells))
    by_id = {s.source_id: s for s in plan.alignment.sources}
    return {s: align_table(tables[s], by_id[s], (filenames or {}).get(s, s), plan.alignment) for s in plan.source_ids if s in ok and s in tables}, cells


def compose(tables: dict[str, DataFrame], plan: CompositionPlan, limit: int | None = None) -> Result:
    """The plan's result over aligned tables, lazy but for the gates of joins and pivots. Order is that of the sources
    and, within one, of its rows. A limit applies to the result of the whole plan."""
    order = ["__source_id", "__source_row"]
    if plan.operation in ("append", "union"):
        result = append_tables(list(tables.values()), plan.append or AppendConfig(), ["__source_row"])
    elif plan.operation == "join":
        left, right = (tables[s] for s in plan.join_inputs)
        result = join_tables(left, right, plan.join, (["__source_row"], ["__source_row"]))
    else:
        base = append_tables(list(tables.values()), plan.append or AppendConfig(), ["__source_row"]).table
        if plan.operation == "aggregate":
            result = Result(aggregate_table(base, plan.aggregate, order))
        elif plan.operation == "pivot":
            result = Result(pivot_table(base, plan.pivot, order))
        else:
            result = Result(unpivot_table(base, plan.unpivot))
    if limit:
        result.table = result.table.limit(limit)
    return result


@dataclass
class BatchRecord:
    run_id: str
    project_id: str
    status: str
    counts: dict[str, int] = field(default_factory=dict)
    outputs: list[dict] = field(default_factory=list)
    excluded_sources: list[str] = field(default_factory=list)
    error_code: str | None = None


def run_composition(spark: SparkSession, tables: dict[str, DataFrame], plan: CompositionPlan, output: str, run_date: str, order: list[str] | None = None, sources: dict[str, tuple[str, str]] | None = None) -> BatchRecord:
    """Aligns, composes, splits and writes everything below output with a manifest; a failure writes one too.

    For append and union the rows in must be the rows out, rejected, in review or dropped as duplicates. sources gives the path
    and the fingerprint of the file behind each table; one that has changed since ends the run before and after it is read.
    """
    from prepweave.sources.catalog import assert_unchanged
    from prepweave.plans.evidence import output_manifest, write_documents, write_evidence, write_manifest, write_split

    run = BatchRecord(f"batch-{uuid.uuid4().hex[:12]}", plan.project_id, "running")
    try:
        for place in (sources or {}).values():
            assert_unchanged(spark, *place)
        ready, cells = aligned(tables, plan)
        run.excluded_sources = [s for s in plan.source_ids if s not in ready]
        result = compose(ready, plan)
        parts = {"processed": result.table, "rejected": result.rejected, "review": result.review, "left_unmatched": result.left_unmatched, "right_unmatched": result.right_unmatched, "diagnostics": result.diagnostics}
        write_evidence(parts | {"alignment": spark.createDataFrame(cells, "source_id string, field_id string, status string, source_column string, action string")}, output, "parquet")
        run.counts = {k: spark.read.parquet(f"{output}/{k}").count() for k, df in parts.items() if df is not None}
        if plan.operation in ("append", "union"):
            run.counts["read"] = sum(t.count() for t in ready.values())
            run.counts["dropped_duplicates"] = result.surplus.first()[0] if result.surplus is not None else 0
            if run.counts["read"] != sum(run.counts.get(k, 0) for k in ("processed", "rejected", "review", "dropped_duplicates")):
                raise PlanError("ROW_RECONCILIATION_FAILED", str(run.counts))
        for place in (sources or {}).values():
            assert_unchanged(spark, *place)
        if plan.split:
            written = spark.read.parquet(f"{output}/processed")
            split = split_table(written, plan.split, order or [c for c in written.columns])
            run.outputs = write_split(split, plan.split, f"{output}/split", run_date)
        run.status = "partial" if run.excluded_sources else "succeeded"
        # what went in and how, beside the tables, and every file with its hash; sources themselves are never part of it
        documents = {
            "applied-plan": asdict(plan),
            "schema-alignment": cells,
            "source-manifest": [{"source_id": s, "columns": dict(t.dtypes), "path": (sources or {}).get(s, (None, None))[0], "fingerprint": (sources or {}).get(s, (None, None))[1]} for s, t in tables.items()],
            "rejected-files": run.excluded_sources,
            "batch-summary": {"run_id": run.run_id, "operation": plan.operation, "sources": len(tables), "sources_used": len(ready), "counts": run.counts, "outputs": len(run.outputs)},
            "audit-log": {"run_id": run.run_id, "project_id": run.project_id, "operation": plan.operation, "run_date": run_date},
        }
        write_documents(spark, documents, output)
        output_manifest(spark, output, run.counts)
    except PlanError as e:
        run.status, run.error_code = "failed", e.code
        write_manifest(spark, run, output)
        raise
    write_manifest(spark, run, output)
    return run
