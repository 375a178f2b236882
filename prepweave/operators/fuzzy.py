"""Fuzzy reconciliation: rows of two tables matched one to one by texts that differ by a few edits.

Candidates come from forms with up to k characters left out: two texts within k edits share one, and hardly any others do,
so that their number follows that of near pairs. Long texts have too many forms; of those, two texts within k edits share one
of their k * q + 1 rarest grams of q characters. Different texts are compared, not rows, so that a frequent name is one
candidate. Pairs are assigned by rounds of mutual best, which is the greedy order of all pairs. Joins are never broadcast,
as what Spark takes for small by its compressed size would have to pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.errors import PlanError
from prepweave.tables import written

#: Characters of a gram at most, and forms of a text at most, beyond which it is compared by its grams.
GRAM, FORMS = 6, 600
#: Marks at both ends of a text, so that its first and last characters have as many grams as others.
EDGE = "\x02"
#: Of the forms' hashes: an odd base, its inverse modulo 2 ** 64, and a factor that spreads code points.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = pow(int(BASE), -1, 2**64)


def _grams(text: Column, size: int) -> Column:
    """The grams of a text, each with its number among equal ones, so that repeats count."""
    padded = F.concat(F.lit(EDGE), text, F.lit(EDGE))
    places = F.sequence(F.lit(1), F.length(padded) - size + 1)
    grams = F.transform(places, lambda i: F.substring(padded, i, F.lit(size)))
    return F.transform(grams, lambda g, i: F.concat(g, F.lit(":"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def _form_length(edits: int) -> int:
    """The greatest length of texts with at most FORMS forms; longer ones share a gram of two characters at least."""
    n = 2 * edits
    while n < 32 and sum(comb(n + 1, i) for i in range(edits + 1)) <= FORMS:
        n += 1
    return n


def _hashes(codes: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes of texts of one length, a row of code points each, with 0 to `edits` characters left out in all ways: the
    texts' rows, the hashes and how many are left out. Polynomials modulo 2 ** 64, so a hash is a sum over the pieces left."""
    n, length = codes.shape
    powers = np.cumprod(np.append(np.uint64(1), np.full(length, BASE)), dtype=np.uint64)
    sums = np.zeros((n, length + 1), np.uint64)
    np.cumsum(((codes + np.uint64(1)) * SPREAD) * powers[:length], axis=1, out=sums[:, 1:])
    # of a run of equal characters the first ones go, so that hardly any two ways give the same form
    new = np.ones((n, length), bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    for cut in range(min(edits, length) + 1):
        places = np.array(list(combinations(range(length), cut)), np.int64).reshape(comb(length, cut), cut)
        begins = np.concatenate([np.zeros((len(places), 1), np.int64), places + 1], axis=1)
        ends = np.concatenate([places, np.full((len(places), 1), length, np.int64)], axis=1)
        found, back, keep = np.full((n, len(places)), np.uint64(length - cut)), 1, np.ones((n, len(places)), bool)
        for i in range(cut + 1):
            found += (sums[:, ends[:, i]] - sums[:, begins[:, i]]) * np.uint64(back)
            back = back * INVERSE % 2**64
            if i < cut:
                keep &= new[:, places[:, i]] | ((places[:, i] == places[:, i - 1] + 1) if i else False)
        rows, columns = np.nonzero(keep)
        yield rows, found[rows, columns].view(np.int64), cut


def _forms(df: DataFrame, side: str, edits: int, longest: int) -> DataFrame:
    """Per text of up to `longest` characters and form: form (a hash), how many characters it leaves out, the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_numpy(), [t.encode("utf-32-le") for t in batch.column(1).to_pylist()]
            lengths = np.array([len(t) // 4 for t in texts])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for some in np.array_split(at, len(at) // 500 + 1):
                    codes = np.frombuffer(b"".join(texts[i] for i in some), np.uint32).reshape(len(some), length).astype(np.uint64)
                    for rows, found, cut in _hashes(codes, edits):
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), cut, np.int8)), pa.array(names[some][rows])], names=["form", f"{side}c", f"{side}h"])

    # a text becomes some hundred rows: what Spark takes for one task's work is dealt out first
    each = df.filter(F.length("text") <= longest).select(F.xxhash64("text").alias("h"), "text")
    each = each.repartition(df.count() // 10_000 + 1, "h")
    return each.mapInArrow(run, f"form long, {side}c tinyint, {side}h long")


def candidates(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """Pairs (l, r) of texts (column text, all different) that may be within so many edits; every pair that is, is there."""
    short = _form_length(edits)
    size = max(2, min(GRAM, (short + 3) // (edits + 1)))  # texts of more than `short` characters within reach share such a gram

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.xxhash64("text").alias(f"{side}h"), F.col("text").alias(side))

    # texts go by a hash, which a join takes back to all texts that have it; equal ones would share all their forms
    same = named(left, "l").join(named(right, "r").hint("merge"), F.col("lh") == F.col("rh")).select("l", "r")
    if not edits:
        return same
    # the longer text of a pair can leave out all its edits, unless it has fewer characters: then both can lose all, form 0
    full = (F.greatest("lc", "rc") == edits) | (F.col("form") == 0)
    forms = [_forms(df, side, edits, short + edits) for df, side in ((left, "l"), (right, "r"))]
    met = forms[0].join(forms[1].hint("merge"), "form").filter((F.col("lh") != F.col("rh")) & full).select("lh", "rh").distinct()
    met = met.join(named(left, "l").hint("merge"), "lh").join(named(right, "r").hint("merge"), "rh").filter(F.least(F.length("l"), F.length("r")) <= short).select("l", "r")

    long = lambda df: df.filter(F.length("text") > short).select("text", F.explode(_grams(F.col("text"), size)).alias("gram"))
    counts = long(left).unionByName(long(right)).groupBy("gram").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, side: str) -> DataFrame:
        # a text's own grams, rarest first; a text is one window of its length
        ranked = long(df).join(counts.hint("merge"), "gram").withColumn("__place", F.row_number().over(W.partitionBy("text").orderBy("n", "gram")))
        return ranked.filter(F.col("__place") <= edits * size + 1).select("gram", F.col("text").alias(side))

    near = prefix(left, "l").join(prefix(right, "r").hint("merge"), "gram").filter((F.abs(F.length("l") - F.length("r")) <= edits) & (F.xxhash64("l") != F.xxhash64("r"))).select("l", "r").distinct()
    return met.unionByName(same).unionByName(near)


def fuzzy_match(left: DataFrame, right: DataFrame, keys: tuple[str, str], texts: tuple[str, str], edits: int = 2, rounds: int = 100) -> DataFrame:
    """One-to-one pairs: left_key, right_key, distance. Texts are compared in lower case and trimmed; null or empty ones match
    nothing.

    Pairs are taken in the order of distance, left text and right text, as long as both texts have rows left; rows of one
    text are taken by key. Keys are unique on their side. Each round takes all pairs that are the best left for both of
    their texts; more than `rounds` of them are an error.
    """
    if edits < 0 or any(c not in df.columns for df, c in ((left, keys[0]), (left, texts[0]), (right, keys[1]), (right, texts[1]))):
        raise PlanError("FUZZY_MATCH_INVALID", f"{keys} {texts} {edits}")
    side = lambda df, k, t: df.select(F.col(f"`{k}`").alias("key"), F.trim(F.lower(F.col(f"`{t}`").cast("string"))).alias("text")).filter("text <> '' AND key IS NOT NULL")
    l, r = written(side(left, keys[0], texts[0]), "left"), written(side(right, keys[1], texts[1]), "right")
    have = lambda df: df.groupBy("text").agg(F.count("*").alias("n"))
    lefts, rights = written(have(l), "lefts"), written(have(r), "rights")
    distance = F.levenshtein("l", "r", edits)
    edges = candidates(lefts, rights, edits).withColumn("distance", distance).filter(F.col("distance").between(0, edits))
    edges = written(edges.join(lefts.select(F.col("text").alias("l"), F.col("n").alias("ln")).hint("merge"), "l").join(rights.select(F.col("text").alias("r"), F.col("n").alias("rn")).hint("merge"), "r"), "edges")
    taken = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        rank = F.struct("distance", "l", "r")
        best_l = edges.groupBy("l").agg(F.min(rank).alias("b")).select("b.*")
        best_r = edges.groupBy("r").agg(F.min(rank).alias("b")).select("b.*")
        both = best_l.join(best_r.hint("merge"), ["distance", "l", "r"])
        pairs = written(both.join(edges.hint("merge"), ["distance", "l", "r"]).withColumn("m", F.least("ln", "rn")), "pairs")
        taken.append(pairs)
        used_l, used_r = pairs.select("l", F.col("m").alias("ul")), pairs.select("r", F.col("m").alias("ur"))
        rest = edges.join(pairs.select("l", "r").hint("merge"), ["l", "r"], "left_anti").join(used_l.hint("merge"), "l", "left").join(used_r.hint("merge"), "r", "left")
        rest = rest.withColumn("ln", F.col("ln") - F.coalesce("ul", F.lit(0))).withColumn("rn", F.col("rn") - F.coalesce("ur", F.lit(0))).filter("ln > 0 AND rn > 0").drop("ul", "ur")
        edges = written(rest, "edges")
    else:
        raise PlanError("FUZZY_MATCH_ROUNDS", str(rounds))
    kind = f"left_key {l.schema['key'].dataType.simpleString()}, right_key {r.schema['key'].dataType.simpleString()}, distance int"
    if not taken:
        return left.sparkSession.createDataFrame([], kind)
    pairs = reduce(DataFrame.unionByName, [p.select("l", "r", "distance", "m", F.lit(i).alias("round")) for i, p in enumerate(taken)])
    # the rows of a text are dealt to its pairs one pair after the other; a text has a pair a round at most
    earlier = lambda c: F.coalesce(F.sum("m").over(W.partitionBy(c).orderBy("round").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pairs = written(pairs.withColumn("lf", earlier("l")).withColumn("rf", earlier("r")), "pairs")
    each = pairs.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    number = lambda df, c: df.withColumn("place", F.row_number().over(W.partitionBy("text").orderBy("key"))).select(F.col("text").alias(c), "place", F.col("key").alias(f"{c}_key"))
    out = each.withColumn("lp", F.col("lf") + F.col("i")).withColumn("rp", F.col("rf") + F.col("i"))
    ln, rn = number(l, "l"), number(r, "r")
    out = out.join(ln.hint("merge"), (out["l"] == ln["l"]) & (F.col("lp") == ln["place"])).drop(ln["l"], ln["place"])
    out = out.join(rn.hint("merge"), (out["r"] == rn["r"]) & (F.col("rp") == rn["place"])).drop(rn["r"], rn["place"])
    return out.select(F.col("l_key").alias("left_key"), F.col("r_key").alias("right_key"), F.col("distance").cast("int").alias("distance"))
