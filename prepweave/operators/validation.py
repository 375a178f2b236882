"""Validation rules: one array of findings a row, in one pass, and the split into accepted and rejected rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.functions import text
from prepweave.operators.cleaning import ROW_ID

FINDINGS = "__findings"
SEVERITIES = ("information", "warning", "error", "blocking")
PATTERN_LIMIT = 500


@dataclass(frozen=True)
class Rule:
    id: str
    rule_type: str
    field_id: str
    reason_code: str
    severity: str = "error"
    message: str = ""
    config: dict[str, Any] = field(default_factory=dict)


def _number(s: Column) -> Column:
    return F.replace(text.trim(s), F.lit(","), F.lit("")).try_cast("decimal(38,10)")


def valid_type(s: Column, data_type: str) -> Column:
    """Whether a text can be read as the type."""
    t = text.trim(s)
    if data_type == "integer":
        return F.replace(t, F.lit(","), F.lit("")).rlike(r"^[+-]?\d+$")
    if data_type == "decimal":
        return F.replace(t, F.lit(","), F.lit("")).rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)$")
    if data_type == "boolean":
        return F.lower(t).isin("true", "false", "yes", "no", "1", "0")
    if data_type == "date":
        return t.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.try_cast("date").isNotNull()
    if data_type == "datetime":
        return t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$") & t.try_cast("timestamp").isNotNull()
    return F.lit(True)


def invalid(rule: Rule, repeated: Column | None = None) -> Column:
    """Where a row breaks the rule. Missing values pass all rules but `required`. repeated tells where a value that must be
    unique is not (see annotate())."""
    c = F.col(f"`{rule.field_id}`")
    s, config = c.cast("string"), rule.config
    missing = text.is_blank(c)
    if rule.rule_type == "required":
        return missing
    if rule.rule_type == "data_type":
        bad = ~valid_type(s, config["data_type"])
    elif rule.rule_type == "unique":
        bad = F.lit(False) if repeated is None else repeated
    elif rule.rule_type == "allowed_values":
        bad = ~c.isin(list(config["values"]))
    elif rule.rule_type == "min_max":
        n = _number(s)
        low = F.lit(config.get("min")).cast("decimal(38,10)")
        high = F.lit(config.get("max")).cast("decimal(38,10)")
        bad = n.isNull() | F.coalesce(n < low, F.lit(False)) | F.coalesce(n > high, F.lit(False))
    elif rule.rule_type == "text_length":
        n = F.length(s)
        bad = (n < F.lit(config["min"]) if config.get("min") is not None else F.lit(False)) | (n > F.lit(config["max"]) if config.get("max") is not None else F.lit(False))
    elif rule.rule_type == "regex":
        if len(config["pattern"]) > PATTERN_LIMIT:
            raise PlanError("VALIDATION_PATTERN_TOO_LONG", rule.id)
        bad = ~s.rlike(rf"\A(?:{config['pattern']})\z")
    else:
        raise PlanError("VALIDATION_RULE_UNSUPPORTED", rule.rule_type)
    return ~missing & F.coalesce(bad, F.lit(False))


def annotate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds the array of a row's findings, in the order of the rules.

    For a unique rule values are counted first, in each task before they meet, and those that come more than once are
    joined back: a value that half of the rows have is one row on that side, and its rows are split like any skewed join's.
    """
    for r in rules:
        if r.field_id not in df.columns:
            raise PlanError("VALIDATION_FIELD_NOT_FOUND", r.field_id)
        if r.severity not in SEVERITIES:
            raise PlanError("VALIDATION_SEVERITY_UNSUPPORTED", r.severity)
    kind = "array<struct<row_id:bigint,field_id:string,rule_id:string,severity:string,reason_code:string,message:string,original_value:string>>"
    if not rules:
        return df.withColumn(FINDINGS, F.array().cast(kind))
    row = F.col(ROW_ID).cast("long") if ROW_ID in df.columns else F.lit(None).cast("long")
    rest = df.columns
    for i, f in enumerate(fields := list(dict.fromkeys(r.field_id for r in rules if r.rule_type == "unique"))):
        c = F.col(f"`{f}`")
        many = df.filter(~text.is_blank(c)).groupBy(c.alias(f"__u{i}")).agg(F.count("*").alias("__times")).filter("__times > 1").select(f"__u{i}", F.lit(True).alias(f"__many{i}"))
        df = df.join(many, c == F.col(f"__u{i}"), "left")
    repeated = lambda r: F.coalesce(F.col(f"__many{fields.index(r.field_id)}"), F.lit(False)) if r.rule_type == "unique" else None
    parts = [
        F.when(
            invalid(r, repeated(r)),
            F.struct(
                row.alias("row_id"), F.lit(r.field_id).alias("field_id"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"),
                F.lit(r.reason_code).alias("reason_code"), F.lit(r.message).alias("message"), F.col(f"`{r.field_id}`").cast("string").alias("original_value"),
            ),
        )
        for r in rules
    ]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.array_compact(F.array(*parts)).cast(kind).alias(FINDINGS))


def findings(annotated: DataFrame) -> DataFrame:
    return annotated.select(F.explode(FINDINGS).alias("f")).select("f.*")


def rejecting() -> Column:
    return F.exists(FINDINGS, lambda f: f["severity"].isin("error", "blocking"))


def split(annotated: DataFrame, reasons: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; the rejected have __reason_codes: those of the findings, then those of column reasons."""
    own = F.transform(F.filter(FINDINGS, lambda f: f["severity"].isin("error", "blocking")), lambda f: f["reason_code"])
    codes = F.concat(own, F.col(reasons)) if reasons else own
    bad = rejecting() | (F.size(reasons) > 0 if reasons else F.lit(False))
    drop = [c for c in (FINDINGS, reasons) if c]
    return annotated.filter(~bad).drop(*drop), annotated.filter(bad).withColumn("__reason_codes", F.array_join(F.array_distinct(codes), ",")).drop(*drop)
