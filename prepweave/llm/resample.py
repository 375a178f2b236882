"""Importance resampling towards a target corpus by hashed runs of words, told from a table of word positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.llm.common import written
from prepweave.tables import in_ranges

#: A word is a run of characters other than the ASCII ones that are no letter; A to Z are lowered afterwards.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """A to Z only; a word of single bytes has no other upper-case letters."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def position_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", orders: int = 3, buckets: int = 10_000) -> DataFrame:
    """One row a word: __row, the key, and in __b1 to __b<orders> the bucket of the run of that many words that begins
    here, null where the document ends before. A document without a word is one row without a bucket.

    Documents are dealt out by row number before their words are exploded, so that the windows over each document's
    positions need no shuffle of words. Equal keys are different documents. docs is a table in storage, whose rows have
    the same numbers each time they are read.
    """
    picked = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text")).repartition("__row")
    words = F.regexp_extract_all("__text", F.lit(WORDS), F.lit(0))
    placed = picked.select("__row", "__key", F.posexplode_outer(words).alias("__at", "__word")).withColumn("__word", _lowered(F.col("__word")))
    along = W.partitionBy("__row").orderBy("__at")
    placed = placed.withColumns({f"__w{i}": F.lead("__word", i).over(along) for i in range(1, orders)})
    following = [F.col("__word"), *[F.col(f"__w{i}") for i in range(1, orders)]]
    runs = [reduce(lambda run, word: F.concat(run, F.lit(" "), word), following[: i + 1]) for i in range(orders)]  # null with a null word
    return placed.select("__row", "__key", *[(F.crc32(run.cast("binary")) % buckets).cast("int").alias(f"__b{i + 1}") for i, run in enumerate(runs)])


def _columns(runs: DataFrame) -> list[str]:
    return [c for c in runs.columns if c.startswith("__b")]


def bucket_counts(runs: DataFrame) -> DataFrame:
    """How many runs each bucket has; counted in each task before the shuffle, at most a row a bucket each."""
    each = runs.select(F.explode(F.array(*_columns(runs))).alias("bucket")).filter(F.col("bucket").isNotNull())
    return each.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """Per bucket the thousandfold log ratio of its smoothed share in the target to that in the corpus, rounded down.

    `buckets` rows, whatever the corpus. Empty corpora or targets have only the smoothing.
    """
    totals = [float(c.agg(F.sum("n")).first()[0] or 0) for c in (corpus, target)]
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * F.lit(totals[0] + buckets) / ((s + 1) * F.lit(totals[1] + buckets)))).alias("gain"))


def weights(runs: DataFrame, gained: DataFrame) -> DataFrame:
    """Per document: __row, __key, n_words, n_features, weight (the sum of its runs' gains). gained has a row a bucket and
    is broadcast; rows of a document lie together, so that sums are made in the task that reads them."""
    names = _columns(runs)
    for c in names:
        runs = runs.join(F.broadcast(gained.select(F.col("bucket").alias(f"_{c}"), F.col("gain").alias(f"__gain{c}"))), F.col(c) == F.col(f"_{c}"), "left")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"__gain{c}"), F.lit(0)) for c in names])
    held = reduce(lambda a, b: a + b, [F.count(c) for c in names])
    return runs.groupBy("__row", "__key").agg(F.count(names[0]).alias("n_words"), held.alias("n_features"), F.sum(total).alias("weight"))


def _chance(key: Column, seed: int) -> Column:
    """A Gumbel draw, in thousandths, from the first 32 bits of a hash of seed and key; a null key counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", orders: int = 3, buckets: int = 10_000, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42) -> DataFrame:
    """Per document: key, n_features, weight, score, rank (long; null if the document is not drawn).

    Of the N documents with at least least_words words, floor(share * N) of the highest score are drawn, ties by the
    smaller key, then by the rows' order. Texts are read whole; a null text has no words, weight 0 and is never drawn; a
    null key is a document whose key counts as empty in the draw and comes first in ties; repeated rows are documents
    each; an empty table gives an empty result; without a target's rows only smoothing tells buckets apart; other
    columns are not read. Ranks come from ranges of the sorted documents, numbered from the sizes of the ranges before.
    """
    runs = written(position_runs(docs, text, key, orders, buckets), "runs")
    counted = written(bucket_counts(runs), "buckets")
    wanted = written(bucket_counts(position_runs(target, text, text, orders, buckets)), "target")
    scored = weights(runs, written(gains(counted, wanted, buckets), "gains"))
    scored = scored.withColumn("score", F.col("weight") + _chance(F.col("__key"), seed)).withColumn("__can", F.col("n_words") >= least_words)
    placed = in_ranges(scored, F.col("__can").desc(), F.col("score").desc(), F.col("__key").asc(), F.col("__row").asc())
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.count_if("__can").alias("__m"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    drawn = int(sizes.agg(F.sum("__m")).first()[0] or 0) * share[0] // share[1]
    place = F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    out = placed.join(sizes.select("__part", "__base"), "__part").withColumn("rank", F.when(F.col("__can") & (place <= drawn), place))
    return out.select(F.col("__key").alias(key), "n_features", "weight", "score", "rank")
