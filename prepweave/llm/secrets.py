"""Secret scan: fixed patterns, and strings that a character Markov model finds more random than ordinary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.llm.common import drawn, hits_and_gaps, span_text, spans, without

#: Fixed patterns; a match that fails its test is dropped and not retried. Possessive repeats give the same
#: matches as greedy ones here, since no repeated class can also match what follows it, and never backtrack.
ASSIGN = r"(?i:password|passwd|secret|token|api_?+key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?+key)[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)$"
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # 20 characters or more; a shorter run holds no longer one
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Characters of the model, and the tokens that it scores.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{3,}+"
KINDS = ("assign", "access", "hex", "markov")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __base: the spans of the fixed patterns by start, then kind; null text counts as empty."""
    df = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__text")
    df = hits_and_gaps(
        df,
        "__text",
        {
            "assign": (ASSIGN, t.rlike(r"(?i:passw|secret|token|api_?key)")),
            "access": (ACCESS, t.contains("AKIA")),
            "hex": (HEX, t.rlike(r"[0-9a-f]{24}")),
        },
    )
    long_value = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN_VALUE, 1)) >= 6
    df = df.withColumn("__assign", F.filter(spans("assign"), long_value))
    df = df.withColumn("__all", F.concat("__assign", spans("access"), spans("hex")))
    df = without(df, ("assign", "access", "hex"))
    return df.withColumn("__base", _by_start(F.col("__all"))).drop("__assign", "__all")


def _by_start(found: Column) -> Column:
    """Spans by start, then by the order of KINDS."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["hit"].alias("hit")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))


def labelled_samples(docs: DataFrame, text: str = "text", rows: int = 2_000, random_strings: int = 4_000) -> DataFrame:
    """Strings with a label: secret (random) or not.

    Secrets are the values of the fixed patterns and strings drawn uniformly in hexadecimal and base64; ordinary ones
    are the identifiers that stand outside them. At most about `rows` different texts are used, chosen by a hash of the text
    (the documented bound of this classifier's labelled sample).
    """
    total = docs.count()
    share = min(1.0, rows / max(1, total))
    picked = docs.filter(drawn(share, text))
    found = base_spans(picked.select(text).distinct(), text)
    secrets = found.select(F.explode("__base").alias("x")).select(
        F.when(F.col("x.kind") == "assign", F.regexp_extract("x.hit", ASSIGN_VALUE, 1)).otherwise(F.col("x.hit")).alias("value"), F.lit(True).alias("secret")
    )
    outside = F.regexp_replace(F.regexp_replace(F.regexp_replace("__text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = found.select(F.explode(F.regexp_extract_all(outside, F.lit(IDENTIFIER), F.lit(0))).alias("value"), F.lit(False).alias("secret"))
    seed = F.sha2(F.concat(F.lit("random strings"), F.col("id").cast("string")), 256)
    made = docs.sparkSession.range(random_strings).select(
        F.when(F.col("id") % 4 == 0, seed).otherwise(F.base64(F.unhex(seed))).alias("value"), F.lit(True).alias("secret")
    )
    return secrets.unionByName(plain).unionByName(made)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of random against ordinary for each pair of characters.

    Reads columns value and secret. The result has one number for each pair of the alphabet's characters, whatever
    the input's size; an unseen pair is smoothed. With samples of one label only, all ratios are those of the smoothing.
    """
    n = len(ALPHABET)
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = samples.select("secret", F.explode(F.regexp_extract_all("value", F.lit("(?s)(?=(..))"), F.lit(1))).alias("pair"))
    counts = pairs.groupBy("secret", "pair").count()
    rows = counts.select("secret", place(F.substring("pair", 1, 1)).alias("a"), place(F.substring("pair", 2, 1)).alias("b"), "count").filter("a >= 0 and b >= 0").collect()  # at most two for each pair of characters
    table = {True: [smoothing] * (n * n), False: [smoothing] * (n * n)}
    for r in rows:
        table[r["secret"]][r["a"] * n + r["b"]] += r["count"]
    out = []
    for a in range(n):
        sums = {k: sum(v[a * n : a * n + n]) for k, v in table.items()}
        out += [math.log(table[True][a * n + b] / sums[True]) - math.log(table[False][a * n + b] / sums[False]) for b in range(n)]
    return out


def score(value: Column, model: list[float]) -> Column:
    """The sum of the model's log-likelihood ratios over the pairs of characters of a token."""
    n = len(ALPHABET)
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    chars = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when((acc["last"] >= 0) & (c >= 0), F.get(ratios, acc["last"] * n + c)).otherwise(0.0)).alias("sum"))
    return F.aggregate(chars, start, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, model: list[float], text: str = "text", least_score: float = 12.0, least_mean: float = 0.7) -> DataFrame:
    """Adds secret_spans to the documents: array of (kind, start, end, hit), by start, then kind.

    Spans of the fixed patterns always stay. A token outside them becomes a span of kind markov if its log-likelihood
    ratio reaches `least_score` in all and `least_mean` for each character, and it holds a digit and a letter. Null and empty texts
    get an empty array, repeated rows are scanned each for itself, and an empty table gives an empty result. Columns
    whose names begin with two underscores are the operator's own.
    """
    df = base_spans(docs, text)
    df = hits_and_gaps(df, "__text", {"markov": (TOKEN, F.col("__text").rlike(r"[A-Za-z0-9+/_=-]{16}"))})
    df = df.withColumn("__tokens", F.filter(spans("markov"), lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")))
    clear = lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    df = df.withColumn("__tokens", F.filter("__tokens", clear))
    scored = lambda x: (score(x["hit"], model) >= F.greatest(F.lit(least_score), least_mean * F.length(x["hit"])))
    df = df.withColumn("__tokens", F.filter("__tokens", scored))
    df = df.withColumn("secret_spans", F.when(F.size("__tokens") > 0, _by_start(F.concat("__base", "__tokens"))).otherwise(F.col("__base")))
    return without(df, ["markov"]).drop("__tokens", "__text")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of scan()'s result: counts of base spans, their hash and all spans."""
    kind = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", kind("assign"), kind("access"), kind("hex"), F.sha2(span_text(F.col("__base")), 256).alias("base_sha256"), span_text(F.col("secret_spans")).alias("spans"))
