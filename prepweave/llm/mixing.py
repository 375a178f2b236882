"""Mixing sources to target weights: fixed-length blocks, multinomial counts per shard, index permutations, one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.llm.common import WORD, merged, once, row_name, word_count, written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Running totals of a source are built over so many buckets, so that a hot source is not one task.
BUCKETS = 1024
ROUNDS = 24


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source its target: columns source, source_size, weight, target.

    Reads one row per source with columns source and source_size. The sources share `share` times all sizes by weight;
    a target stops at `most` times its source's size and the excess is reshared by weight. With sources ordered by
    most * size / weight, those that stop come first; the level of the others follows from running totals.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy()) * float(share)
    df = df.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    # the first source whose cap lies above the level sets it for itself and all after it
    open_level = F.first(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return df.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * open_level, F.col("cap"))).alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 for each key: the swap-or-not shuffle, exact on any n.

    Each round reflects the index in a keyed point and keeps the reflection or not by a keyed bit of the larger of both,
    which is the same for the two; so each round is its own inverse.
    """

    def step(x, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit("point"), r, *key), n) - x, n)
        bit = F.pmod(F.xxhash64(F.lit("bit"), r, F.greatest(x, other), *key), F.lit(2)) == 1
        return F.when(bit, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the running total of value up to each row, over rows of the same keys (never null) by `order`, an integer that
    each key has once. Totals of ranges of `width` are summed first, so no task holds all rows of a key."""
    df = df.withColumn("__range", F.expr(f"{order} div {width}"))
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    bases = df.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*keys, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__inside", F.sum(value).over(inside)).join(bases, [*keys, "__range"]).withColumn(name, F.col("__base") + F.col("__inside")).drop("__range", "__base", "__inside")


def pack(docs: DataFrame, text: str, block_tokens: int) -> DataFrame:
    """The documents with their size and place in their source's stream of words: adds size, __row (names doc_id, source and text), __offset.

    Within a source the documents are in the order of a hash of their key. Totals of hash buckets are summed per source
    (at most BUCKETS rows each), so no task holds a whole source.
    """
    keyed = docs.withColumn("size", word_count(F.col(text))).withColumn("__row", row_name("doc_id", "source", text)).withColumn("__hash", F.xxhash64(F.lit("order"), "doc_id")).withColumn("__bucket", F.pmod("__hash", F.lit(BUCKETS)))
    sums = keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("__total"))
    bases = sums.withColumn("__base", F.sum("__total").over(W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__total"))
    bases = bases.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__base")
    order = W.partitionBy("source", "__bucket").orderBy("__hash", "doc_id", "size", "__row").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = keyed.withColumn("__inside", F.sum("size").over(order) - F.col("size"))
    joined = inside.join(bases, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("__offset", F.col("__base") + F.col("__inside")).drop("__hash", "__bucket", "__s", "__b", "__base", "__inside")


def slots(sources: DataFrame, block_tokens: int, shard_slots: int, seed: int) -> DataFrame:
    """The blocks that the mix takes: columns shard, source, pass, block.

    Reads targets() rows. Each shard has shard_slots slots. Their source counts are a multinomial draw with the targets
    as chances: each slot draws its source from a hash of the shard and the slot. A source's slots are numbered over all
    shards; those above its quota (target over mean block length) go to sources that the draw left short, so each source
    gets its quota exactly. Slot i is pass i div n and block permuted(i mod n) of the source's n blocks: a block is taken
    again only once all have been taken.
    """
    spark = sources.sparkSession
    counted = sources.filter("source_size > 0 and target > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block_tokens))
    counted = counted.withColumn("quota", F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    counted = written(
        counted.withColumn("n", F.row_number().over(by_name)).withColumn("high", F.sum("quota").over(by_name.rowsBetween(W.unboundedPreceding, 0))).withColumn("low", F.col("high") - F.col("quota")), "quotas"
    )
    total = counted.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shards = -(-total // shard_slots)
    # the interval [low, high) that holds a draw: found by its bucket of equal width, of which an interval spans some
    width = max(1, total // 4096)
    spread = counted.filter("quota > 0").select("n", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("cell"))
    drawn = (
        spark.range(total)
        .select((F.col("id") / shard_slots).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), (F.col("id") / shard_slots).cast("long"), "id"), F.lit(max(1, total))).alias("draw"))
        .withColumn("cell", F.expr(f"draw div {width}"))
    )
    spread = F.broadcast(spread) if counted.count() <= 100_000 else spread  # at most a row per source and per cell
    counts = drawn.join(spread, "cell").filter("draw >= low and draw < high").groupBy("shard", "n").agg(F.count("*").alias("slots"))
    counts = written(counts, "draws")
    placed = running_total(counts, ["n"], "shard", "slots", "__sum").join(counted.select("n", "quota"), "n")
    placed = placed.withColumn("upto", F.least("__sum", "quota")).withColumn("first", F.least(F.col("__sum") - F.col("slots"), F.col("quota"))).withColumn("kept", F.col("upto") - F.col("first")).drop("__sum")
    placed = written(placed, "placed")
    # what was drawn above a quota, in order of shard, meets what other sources lack, in order of source
    spill = placed.groupBy("shard").agg(F.sum(F.col("slots") - F.col("kept")).alias("over")).filter("over > 0")
    spill = running_total(spill, [], "shard", "over", "s_high").withColumn("s_low", F.col("s_high") - F.col("over"))
    lack = counted.select("n", "quota").join(placed.groupBy("n").agg(F.sum("kept").alias("got")), "n", "left").select("n", F.coalesce("got", F.lit(0)).alias("got"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("lack")).filter("lack > 0")
    lack = lack.withColumn("l_high", F.sum("lack").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0))).withColumn("l_low", F.col("l_high") - F.col("lack"))
    step = 4096
    cells = lambda low, high: F.explode(F.expr(f"sequence({low} div {step}, ({high} - 1) div {step})")).alias("cell")
    refill = spill.select("shard", "s_low", "s_high", cells("s_low", "s_high")).join(lack.select("n", "got", "l_low", "l_high", cells("l_low", "l_high")), "cell")
    refill = refill.filter("s_low < l_high and l_low < s_high").select("shard", "n", F.expr("got + greatest(s_low, l_low) - l_low").alias("first"), F.expr("least(s_high, l_high) - greatest(s_low, l_low)").alias("kept")).distinct()
    runs = placed.filter("kept > 0").select("shard", "n", "first", "kept").unionByName(refill)
    # a run is at most a shard's slots; runs are dealt out before each becomes a row a slot
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2_000_000)
    dealt = runs.join(counted.select("n", "source", "n_blocks"), "n").repartition(tasks, "shard", "n")
    each = dealt.select("shard", "source", "n_blocks", F.explode(F.expr("sequence(first, first + kept - 1)")).alias("i"))
    each = each.withColumn("pass", F.expr("i div n_blocks"))
    key = F.lit(seed), F.coalesce("source", F.lit("\0null")), F.col("pass")
    return each.select("shard", "source", "pass", permuted(F.expr("i % n_blocks"), F.col("n_blocks"), *key).alias("block"))


def mix(docs: DataFrame, text: str = "text", block_tokens: int = 64, shard_slots: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Mixes the documents; returns (documents, pieces).

    documents: the input's rows with size, source_size, target (its source's) and taken (words that the mix takes,
    repeats counted). pieces: the mix itself, a row for each part of a document in a block of a shard: shard, pass,
    source, block, doc_id, row (names doc_id, source and text), offset (tells rows of one name apart), start (word of the
    text, from 0), words.

    A null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated rows lie in
    the stream one after the other, each for itself, and their taken words are given for each. An empty table gives empty
    results. Equal input gives equal results. Columns named size, source_size, target or taken are replaced, those that
    begin with two underscores are the operator's own.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    packed = written(pack(docs.select("doc_id", "source", text), text, block_tokens).drop(text), "packed")
    sizes = packed.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(sizes), "targets")
    taken_blocks = slots(sources, block_tokens, shard_slots, seed)
    cut = packed.filter("size > 0").select("doc_id", F.col("__row").alias("row"), "source", "size", F.col("__offset").alias("offset"), F.explode(F.expr(f"sequence(__offset div {block_tokens}, (__offset + size - 1) div {block_tokens})")).alias("block"))
    parts = cut.select("doc_id", "row", "source", "offset", "block", F.expr(f"greatest(offset, block * {block_tokens}) - offset").alias("start"), F.expr(f"least(offset + size, (block + 1) * {block_tokens}) - greatest(offset, block * {block_tokens})").alias("words"))
    b = taken_blocks.select("shard", "pass", F.col("source").alias("__s"), F.col("block").alias("__b"))
    pieces = parts.join(merged(b), F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))).drop("__s", "__b")
    pieces = written(pieces, "pieces")
    per_doc = pieces.groupBy("doc_id", "source", "offset").agg(F.sum("words").alias("__taken"))
    per_doc = per_doc.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("offset").alias("__o"), "__taken")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__offset") == F.col("__o")) & (F.col("size") > 0)
    result = packed.join(merged(per_doc), same, "left").drop("__d", "__s", "__o")
    t = sources.select(F.col("source").alias("__s"), "source_size", "target")
    result = result.join(F.broadcast(t) if sources.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("__s")), "left")
    return result.select("doc_id", "source", F.col("__offset").alias("offset"), "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).cast("long").alias("taken")), pieces


def mixed_texts(docs: DataFrame, pieces: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the words that the mix takes of them, joined by spaces, a pass after the other; documents of
    which it takes none go. Null and repeated doc_ids are documents like others; rows equal in doc_id, source and text get
    the words of one of them each."""
    runs = pieces.groupBy("row", "offset").agg(F.sort_array(F.collect_list(F.struct("pass", "start", "words"))).alias("runs"))
    each = runs.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("offset", "runs"))).alias("__each"))
    others = [c for c in docs.columns if c not in ("doc_id", "source", text)]
    order = W.partitionBy("__row").orderBy(F.xxhash64(*others) if others else F.lit(0))
    # the rows of one name, in any order, meet the places that the stream gave them
    joined = docs.withColumn("__row", row_name("doc_id", "source", text)).withColumn("__n", F.row_number().over(order) - 1).join(merged(each), "__row")
    joined = joined.withColumn("__runs", F.get("__each", F.col("__n"))["runs"]).filter("__runs is not null")
    take = lambda words: F.array_join(F.transform("__runs", lambda r: F.array_join(F.slice(words, (r["start"] + 1).cast("int"), r["words"].cast("int")), " ")), " ")
    return joined.withColumn(text, once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), take)).drop("__runs", "__each", "__n", "__row")
