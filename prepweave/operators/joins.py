"""Joins with normalised keys, explicit null and duplicate rules, and a check of cardinality before the join."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.functions import text
from prepweave.operators.append import Result
from prepweave.operators.cleaning import need

NORMALISERS = {"trim": text.trim, "lowercase": F.lower, "uppercase": F.upper, "normalise_spaces": text.normalise_spaces}
TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


@dataclass(frozen=True)
class JoinConfig:
    join_type: str
    left_keys: list[str]
    right_keys: list[str]
    key_normalisation: list[str] = field(default_factory=list)
    null_key_policy: str = "never_match"
    duplicate_key_policy: str = "block_many_to_many"
    approve_many_to_many: bool = False
    output_fields: list[str] = field(default_factory=list)
    suffix: str = "_right"
    #: The side (left or right) whose keys are known to be unique, so that many rows can't meet many.
    unique_side: str | None = None

    def __post_init__(self):
        if not self.left_keys or len(self.left_keys) != len(self.right_keys):
            raise PlanError("JOIN_KEYS_INVALID")
        if self.join_type not in TYPES:
            raise PlanError("JOIN_TYPE_UNSUPPORTED", self.join_type)
        if unknown := [n for n in self.key_normalisation if n not in NORMALISERS]:
            raise PlanError("JOIN_NORMALISATION_UNSUPPORTED", ", ".join(unknown))
        if self.unique_side not in (None, "left", "right"):
            raise PlanError("JOIN_UNIQUE_SIDE_UNSUPPORTED", self.unique_side)
        if self.null_key_policy not in ("never_match", "match_nulls", "reject"):
            raise PlanError("JOIN_NULL_POLICY_UNSUPPORTED", self.null_key_policy)
        if self.duplicate_key_policy not in ("block_many_to_many", "allow", "keep_first", "keep_last", "review"):
            raise PlanError("JOIN_DUPLICATE_POLICY_UNSUPPORTED", self.duplicate_key_policy)


def _key_names(n: int) -> list[str]:
    return [f"__join_key_{i}" for i in range(n)]


def keyed(left: DataFrame, right: DataFrame, config: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """Both sides with the normalised keys. A key that nothing normalises and that both sides type alike stays as it is, so
    that buckets and filters on it serve the join; other keys are compared as text."""
    need(left, config.left_keys, "JOIN_KEYS_NOT_FOUND")
    need(right, config.right_keys, "JOIN_KEYS_NOT_FOUND")
    normal = lambda c: reduce(lambda x, n: NORMALISERS[n](x), config.key_normalisation, c)
    kinds = [dict(df.dtypes) for df in (left, right)]
    plain = [not config.key_normalisation and kinds[0][a] == kinds[1][b] for a, b in zip(config.left_keys, config.right_keys)]
    sides = []
    for df, keys in ((left, config.left_keys), (right, config.right_keys)):
        sides.append(df.withColumns({k: F.col(f"`{c}`") if as_is else normal(F.col(f"`{c}`").cast("string")) for k, c, as_is in zip(_key_names(len(keys)), keys, plain)}))
    return sides[0], sides[1]


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def analyse(left: DataFrame, right: DataFrame, config: JoinConfig) -> DataFrame:
    """One row: cardinality, rows of each side, null keys, repeated keys, and the rows that each join type would give.

    Both sides are counted per key first, so the join sees a row per key and side.
    """
    keys = _key_names(len(config.left_keys))
    nulls = config.null_key_policy == "match_nulls"
    a, b = (df.groupBy(*keys).agg(F.count("*").alias(f"__{name}")).alias(alias) for df, name, alias in zip(keyed(left, right, config), "lr", "ab"))
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if nulls else F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    null = lambda side: reduce(lambda x, y: x | y, [F.col(f"{side}.{k}").isNull() for k in keys])
    met = a.join(b, on, "full").select(F.col("__l").alias("l"), F.col("__r").alias("r"), null("a").alias("an"), null("b").alias("bn"))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    facts = met.agg(
        z("l").alias("left_rows"),
        z("r").alias("right_rows"),
        z(F.when(F.col("l").isNotNull() & F.col("an"), F.col("l"))).alias("null_left_keys"),
        z(F.when(F.col("r").isNotNull() & F.col("bn"), F.col("r"))).alias("null_right_keys"),
        z(F.when(F.col("l") > 1, F.col("l"))).alias("duplicate_left_rows"),
        z(F.when(F.col("r") > 1, F.col("r"))).alias("duplicate_right_rows"),
        z(F.when(both, F.col("l") * F.col("r"))).alias("inner_rows"),
        z(F.when(both, F.col("l"))).alias("matched_left"),
        z(F.when(both, F.col("r"))).alias("matched_right"),
        F.coalesce(F.max(F.when(both | ~(F.col("an") & F.lit(not nulls)), F.col("l"))), F.lit(0)).alias("most_left"),
        F.coalesce(F.max(F.when(both | ~(F.col("bn") & F.lit(not nulls)), F.col("r"))), F.lit(0)).alias("most_right"),
    )
    many_l, many_r = F.col("most_left") > 1, F.col("most_right") > 1
    kind = F.when(many_l & many_r, "many_to_many").when(many_r, "one_to_many").when(many_l, "many_to_one").otherwise("one_to_one")
    un_l, un_r = F.col("left_rows") - F.col("matched_left"), F.col("right_rows") - F.col("matched_right")
    estimate = {"inner": F.col("inner_rows"), "left": F.col("inner_rows") + un_l, "right": F.col("inner_rows") + un_r, "full": F.col("inner_rows") + un_l + un_r, "semi": F.col("matched_left"), "anti": un_l}[config.join_type]
    out = facts.withColumns({"cardinality": kind, "left_unmatched": un_l, "right_unmatched": un_r, "estimated_rows": estimate})
    out = out.withColumn("expansion", F.col("estimated_rows") / F.greatest(F.lit(1), F.col("left_rows") + F.col("right_rows")))
    gate = F.lit(config.duplicate_key_policy == "block_many_to_many" and not config.approve_many_to_many)
    return out.withColumn("blocked", gate & (F.col("cardinality") == "many_to_many")).drop("most_left", "most_right")


def join_tables(left: DataFrame, right: DataFrame, config: JoinConfig, order: tuple[list[str], list[str]] | None = None) -> Result:
    """Joins two tables; also gives what found no partner on each side, and with policy review the repeated keys.

    All left columns come first, then the right ones, a name that the left has with the suffix. Keys are compared after
    normalisation and do not show. Two jobs run before: the cardinality gate, unless a side is declared unique, and with policy
    reject the null check.
    order gives the fields that order each side's rows for keep_first and keep_last.
    """
    keys = _key_names(len(config.left_keys))
    l, r = keyed(left, right, config)
    if config.null_key_policy == "reject" and not (l.filter(_any_null(keys)).isEmpty() and r.filter(_any_null(keys)).isEmpty()):
        raise PlanError("JOIN_NULL_KEYS_REJECTED")
    diagnostics = analyse(left, right, config)
    gated = config.duplicate_key_policy == "block_many_to_many" and not config.approve_many_to_many and not config.unique_side
    if gated and diagnostics.first()["blocked"]:
        raise PlanError("JOIN_MANY_TO_MANY_APPROVAL_REQUIRED")
    review = None
    if config.duplicate_key_policy == "review" or config.approve_many_to_many:

        def repeated(df: DataFrame, side: str) -> DataFrame:
            # keys are counted before they meet the rows, so that a frequent key is not one task's window
            many = df.groupBy(*[F.col(k).alias(f"{k}_n") for k in keys]).agg(F.count("*").alias("__n")).filter("__n > 1")
            again = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_n")) for k in keys])
            return df.join(many, again, "left_semi").drop(*keys).withColumns({"__join_side": F.lit(side), "__reason_codes": F.lit("DUPLICATE_JOIN_KEY")})

        from prepweave.operators.append import union_by_name

        review = union_by_name([repeated(l, "left"), repeated(r, "right")])
    if config.duplicate_key_policy in ("keep_first", "keep_last"):
        best = F.max_by if config.duplicate_key_policy == "keep_last" else F.min_by

        def one(df: DataFrame, fields: list[str]) -> DataFrame:
            # combined before the shuffle, so a frequent key sends a row from each task
            row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
            kept = df.groupBy(*keys).agg(best(row, F.struct(*[F.col(f"`{c}`") for c in fields])).alias("__row"))
            return kept.select("__row.*", *keys)

        orders = order or (sorted(left.columns), sorted(right.columns))
        l, r = one(l, orders[0]), one(r, orders[1])
    renamed = {c: c + config.suffix if c in left.columns else c for c in right.columns}
    right_out = r.select(*[F.col(f"`{c}`").alias(n) for c, n in renamed.items()], *[F.col(k).alias(f"{k}_r") for k in keys])
    same = lambda k: F.col(k).eqNullSafe(F.col(f"{k}_r")) if config.null_key_policy == "match_nulls" else F.col(k) == F.col(f"{k}_r")
    on = reduce(lambda a, b: a & b, map(same, keys))
    joined = l.join(right_out, on, TYPES[config.join_type])
    names = list(left.columns) + ([] if config.join_type in ("semi", "anti") else list(renamed.values()))
    if config.output_fields:
        if missing := [f for f in config.output_fields if f not in names]:
            raise PlanError("JOIN_OUTPUT_FIELDS_NOT_FOUND", ", ".join(missing))
        names = config.output_fields
    only_keys_r = right_out.select(*[f"{k}_r" for k in keys])
    left_un = l.join(only_keys_r, on, "left_anti").select(*left.columns)
    back = r.select(*right.columns, *[F.col(k).alias(f"{k}_r") for k in keys])
    right_un = back.join(l.select(*keys), on, "left_anti").select(*right.columns)
    return Result(joined.select(*names), review=review, left_unmatched=left_un, right_unmatched=right_un, diagnostics=diagnostics)
