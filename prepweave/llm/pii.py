"""Personal data: fixed patterns, and terms that disclose an entity by the information that they carry about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.llm.common import cut_out, hits_and_gaps, merged, row_name, small, span_text, spans, with_steps, without, written

#: Fixed patterns; a match that fails its test is dropped and not retried. Possessive repeats match as greedy ones do
#: here. The look-behind (or the end of the last match, \G) skips starts inside a run that has already failed.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
TERM = r"[\p{L}\p{N}]{3,}+"
KINDS = ("email", "ip", "card", "phone")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, (n - i).cast("int"), F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __base: the spans of the fixed patterns by kind, then start; null text counts as empty."""
    df = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__text")
    df = hits_and_gaps(
        df,
        "__text",
        {
            "email": (EMAIL, t.contains("@")),
            "ip": (IP, t.rlike(r"[0-9]\.[0-9]")),
            "card": (CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
            "phone": (PHONE, t.rlike(r"\+[0-9]")),
        },
    )
    digits = lambda x, keep="[^0-9]": F.regexp_replace(x["hit"], keep, "")
    tests = {
        "email": None,
        "ip": lambda x: x["hit"].rlike(IP_PARTS),
        "card": lambda x: F.when(F.length(digits(x)).between(16, 19), _luhn(digits(x))).otherwise(False),
        "phone": lambda x: F.length(digits(x)).between(8, 15),
    }
    df = df.withColumns({f"__{k}": spans(k) if test is None else F.filter(spans(k), test) for k, test in tests.items()})
    df = df.withColumn("__base", F.concat(*[f"__{k}" for k in KINDS]))
    return without(df, KINDS).drop(*[f"__{k}" for k in KINDS])


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _entity(span: Column) -> Column:
    """One entity whatever its writing: kind and lower-case text, or kind and digits."""
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["hit"], "[^0-9]", "")).otherwise(F.lower(span["hit"]))
    return F.concat_ws(":", span["kind"], plain)


def disclosing_terms(docs: DataFrame, found: DataFrame | None = None, text: str = "text", window: int = 60, support: int = 3, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """Terms of the corpus that reveal a protected entity: columns term, entity, disclosure, removed.

    Entities are the values that the fixed patterns find. A term t co-occurs with an entity e in a document if it stands
    within `window` characters of a mention of e. With counts of documents, disclosure is PMI(t; e) / IC(e) =
    ln(n(t,e) N / (n(t) n(e))) / ln(N / n(e)): 1 if t is found only beside e, 0 if both are independent. A term is kept
    here if it reaches `generalise`, and is removed from `remove` on. Evidence is counted over different texts in
    different contexts, at least `support` of them, so that copies of one passage do not make each rare word a
    disclosing one. n(t) is counted over whole texts of all documents. `found` is base_spans() of
    the documents, if there is a table of it.
    """
    found = base_spans(docs, text) if found is None else found
    found = found.select("__text", "__base").filter(F.size("__base") > 0)
    total = docs.count()
    mentions = found.select("__text", "__base", F.explode("__base").alias("x")).select(
        _entity(F.col("x")).alias("entity"),
        F.substring("__text", (F.greatest(F.col("x.start") - window, F.lit(0)) + 1).cast("int"), F.least(F.col("x.start"), F.lit(window)).cast("int")).alias("before"),
        F.substring("__text", (F.col("x.end") + 1).cast("int"), F.lit(window)).alias("after"),
        F.xxhash64("__text").alias("in_text"),
        (F.col("x.start") > window).alias("cut_before"),
        (F.col("x.end") + window < F.length("__text")).alias("cut_after"),
    )
    # a word that the window's edge may have cut is no evidence; the text's own begin and end cut none
    before = F.when(F.col("cut_before"), F.regexp_replace("before", r"^[\p{L}\p{N}]+", "")).otherwise(F.col("before"))
    after = F.when(F.col("cut_after"), F.regexp_replace("after", r"[\p{L}\p{N}]+$", "")).otherwise(F.col("after"))
    whole = F.concat_ws(" ", before, after)
    mentions = mentions.select("entity", "in_text", F.explode(F.array_distinct(_terms(whole))).alias("term"), F.xxhash64("before", "after").alias("context"))
    mentions = written(mentions, "mentions")
    entities = found.select(F.explode(F.array_distinct(F.transform("__base", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    each_text = mentions.groupBy("entity", "term", "in_text").agg(F.min("context").alias("context"))
    contexts = each_text.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= support)
    # terms are counted and written before they meet the candidates, of which common words are the most frequent by far
    counted = docs.select(F.explode(F.array_distinct(_terms(F.coalesce(F.col(text), F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    candidates = contexts.join(entities, "entity").join(merged(written(counted, "term-counts")), "term")
    # n(t,e) is at most n(e), so a term of more documents than this stays below the least disclosure whatever n(t,e) is
    every = float(max(total, 1))
    most = F.lit(every) * F.pow(F.col("n_entity") / F.lit(every), F.lit(float(generalise)))
    candidates = written(candidates.filter(F.col("n_term") <= most * (1 + 1e-9)).select("entity", "term", "n_entity", "n_term"), "candidates")
    # both counts take a document as often as it stands in the corpus
    beside = found.select(F.xxhash64("__text").alias("in_text")).groupBy("in_text").agg(F.count("*").alias("copies"))
    asked = small(candidates, 200_000)
    joined = mentions.join(asked, ["entity", "term"]).select("entity", "term", "n_entity", "n_term", "in_text").distinct().join(beside, "in_text").groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("copies").alias("n_both"))
    ic = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    pmi = F.log(F.col("n_both") * F.lit(float(max(total, 1))) / (F.col("n_term") * F.col("n_entity")))
    scored = joined.select("term", "entity", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("disclosure"))
    return scored.filter(F.col("disclosure") >= generalise).withColumn("removed", F.col("disclosure") >= remove)


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """Adds __base (spans of the fixed patterns) and __terms (spans of disclosing terms outside them, by start).

    The kind of a term's span is `term` if it is to be removed, `generalised` if a class is to stand for it. A null or
    empty text has no spans; rows that repeat a key are searched each for itself; an empty table gives an empty result.
    Columns whose names begin with two underscores are the operator's own.
    """
    spanned = written(base_spans(docs, text).withColumn("__row", row_name(key, text)).withColumn("__null", F.col(text).isNull()).drop(text), "spanned")
    spanned = spanned.withColumn(text, F.when(~F.col("__null"), F.col("__text"))).select(*docs.columns, "__text", "__base", "__row")
    marked = written(disclosing_terms(docs, spanned, text, **settings).groupBy("term").agg(F.max("removed").alias("removed")), "disclosing")
    # rows are named by key and text, so that many rows with one key, or none, are not one group
    terms = docs.select(row_name(key, text).alias("__named"), F.explode(F.array_distinct(_terms(F.coalesce(F.col(text), F.lit(""))))).alias("term"))
    per_doc = (
        terms.join(small(marked, 100_000), "term")
        .groupBy("__named")
        .agg(F.sort_array(F.collect_set("term")).alias("__words"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("__gone"))
    )
    per_doc = small(written(per_doc, "terms"), 20_000)
    df = spanned.join(per_doc, F.col("__row") == F.col("__named"), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("__words", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    some = F.col("__words").isNotNull()
    df = df.withColumn("__hits_term", F.when(some, F.regexp_extract_all("__text", pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__gaps_term", F.when(some, F.transform(F.split("__text", pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
    df = with_steps(df, ["term"])
    df = df.withColumn("__terms", F.filter(spans("term"), lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    rename = lambda x: F.struct(F.when(F.array_contains("__gone", F.lower(x["hit"])), "term").otherwise("generalised").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"))
    return without(df, ["term"]).withColumn("__terms", F.transform("__terms", rename)).drop("__words", "__gone", "__named", "__row")


def sanitise(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span replaced: <EMAIL> and the like for personal data, a class of the term's shape for
    a generalised term, nothing for a removed one. Where spans of two kinds overlap, they are replaced as one."""
    by_start = F.array_sort(F.transform(F.concat("__base", "__terms"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["hit"].alias("hit"))))
    merged = F.aggregate(
        by_start,
        F.array().cast("array<struct<start:bigint,end:bigint,kind:string,hit:string>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] < F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind"), F.element_at(acc, -1)["hit"].alias("hit"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    shape = lambda x: F.when(x["hit"].rlike(r"^\p{N}+$"), "<NUMBER>").when(x["hit"].rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
    replacement = lambda x: F.when(x["kind"] == "term", "").when(x["kind"] == "generalised", shape(x)).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    df = found.withColumn("__cuts", F.when(F.size("__base") + F.size("__terms") > 0, merged).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:string,hit:string>>")))
    clean = F.when(F.size("__cuts") > 0, cut_out(F.col("__text"), F.col("__cuts"), replacement)).otherwise(F.col(text))
    return df.withColumn(text, clean).drop("__base", "__terms", "__text", "__cuts")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find()'s result."""
    kind = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat_ws(",", F.filter(F.array(span_text(F.col("__base")), span_text(F.col("__terms"))), lambda x: x != ""))
    return found.select("doc_id", *[kind(k) for k in KINDS], F.sha2(span_text(F.col("__base")), 256).alias("base_sha256"), every.alias("spans"), (F.size("__base") + F.size("__terms")).cast("long").alias("n_spans"))
