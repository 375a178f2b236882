"""Quality classifier: document evidence with the posteriors of its host and path, by hierarchical empirical Bayes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.llm.common import drawn, small, written
from prepweave.llm.language import held_out

#: Symbols whose share of a text is a feature of its own each.
SYMBOLS = "#*$%&|<>!"
#: A word also counts by its first letters, since many languages put words together.
PREFIX = 5
LETTERS = regex.compile(r"\p{L}+")
SHAPES = len(SYMBOLS) + 7
#: A prior never weighs more than so many documents; reached where sites do not differ.
MOST_PRIOR = 1e6
EDGE = 1e-6


def site_levels(df: DataFrame, url: str, host: str = "host", path: str = "path") -> DataFrame:
    """Adds the host of a URL and its first path segment, both null without a URL."""
    df = df.withColumn(host, F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))
    return df.withColumn(path, F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 upper-case letter, 2 other letter, 3 digit, 4 white space, 0 other."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kinds[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0
    return kinds


def describe(text: str) -> tuple[set[str], list[float]]:
    """The different words of a text with their prefixes, and its shape: shares of symbols and of kinds of characters, of
    repeated words and lines, word length, and the number of words on a log scale."""
    words = LETTERS.findall(text.lower())
    some, n = set(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=5) / n
    shape = [text.count(c) / n for c in SYMBOLS]
    shape += [kinds[1], kinds[3], kinds[0], 1 - len(some) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words)), min(50.0, n / max(1, len(words)))]
    return some | {w[:PREFIX] + "*" for w in some if len(w) > PREFIX}, shape


class Evidence:
    """Logistic models over words and shape. A label without rows of both classes has a constant chance."""

    def __init__(self, labels: tuple[str, ...], words: list[str], centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.labels, self.centre, self.scale, self.bias = labels, centre, scale, bias
        self.shape_weights = weights[:SHAPES]
        self.by_word = {w: x for w, x in zip(words, weights[SHAPES:])}

    def chances(self, text: str) -> list[float]:
        words, shape = describe(text)
        z = self.bias + ((np.array(shape) - self.centre) / self.scale) @ self.shape_weights
        for w in words:
            if (x := self.by_word.get(w)) is not None:
                z = z + x
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def apply(self, docs: DataFrame, text: str) -> DataFrame:
        """The documents with p_<label> for each label and __empty (the text has no word) in place of the text."""
        kept = [f for f in docs.schema.fields if f.name != text]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + "".join(f", p_{c} double" for c in self.labels) + ", __empty boolean"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t.as_py() or "" for t in batch.column(len(kept))]
                found = list(zip(*[self.chances(t) for t in texts])) or [()] * len(self.labels)
                arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(c, pa.float64()) for c in found] + [pa.array([not LETTERS.search(t) for t in texts], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [f"p_{c}" for c in self.labels] + ["__empty"])

        return docs.select(*[F.col(f.name) for f in kept], F.col(text)).mapInArrow(run, kinds)


def _fit(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with a squared penalty, by accelerated gradient steps."""
    x = np.column_stack((x, np.ones(len(x), np.float32)))
    w = last = np.zeros(x.shape[1], np.float32)
    ridge = np.full(x.shape[1], penalty, np.float32)
    ridge[-1] = 0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, for the length of a step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(x @ v) ** 2 / len(x) + penalty)
    for i in range(rounds):
        at = w + (i / (i + 3)) * (w - last)
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ at, -30, 30))) - y) / len(x) + ridge * at
        last, w = w, at - step * slope
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), text: str = "text", key: str = "doc_id", rows: int = 8_000, words: int = 600, least_docs: int = 5, penalty: float = 3e-4) -> Evidence:
    """Logistic models over words and shape, one for each column of labels.

    At most about `rows` labelled documents that are not held out are used, by a hash of the key (the documented bound
    of the labelled sample), and for each label the `words` words or prefixes, held by least_docs of them, whose shares
    differ most between its classes. A key labelled twice has the largest label. Null labels count as absent; without
    rows of both classes a label's chance is its smoothed share.
    """
    marked = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(*[F.max((F.col(c) > 0).cast("int")).alias(f"__y_{c}") for c in targets])
    marked = written(marked.filter(~held_out("__k")), "labels")
    share = rows / max(rows, marked.count())
    picked = written(marked.filter(drawn(share, "__k")), "picked")
    ys = [f"__y_{c}" for c in targets]
    used = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t")).join(small(picked, 2 * rows), "__k")
    sample = written(used.select("__t", *ys), "sample")
    counts = sample.agg(*[F.count(y).alias(f"n{y}") for y in ys], *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
    both = [i for i, y in enumerate(ys) if 0 < counts[y] < counts[f"n{y}"]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(i, y): Counter() for i in both for y in (0, 1)}
            for t, *marks in zip(*[batch.column(i).to_pylist() for i in range(1 + len(ys))]):
                held = describe(t)[0]
                for i in both:
                    if marks[i] is not None:
                        found[i, marks[i]].update(held)
            for (i, y), c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array([n * (1 - y) for n in c.values()], pa.int64()), pa.array([n * y for n in c.values()], pa.int64())], names=["label", "word", "no", "yes"])

    chosen: list[str] = []
    if both:
        n = {i: (counts[f"n{ys[i]}"] - counts[ys[i]], counts[ys[i]]) for i in both}
        table = sample.mapInArrow(count, "label int, word string, no long, yes long").groupBy("label", "word").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).filter(F.col("no") + F.col("yes") >= least_docs)
        of = lambda k: F.element_at(F.create_map(*[F.lit(x) for i in both for x in (i, float(n[i][k]))]), F.col("label"))
        mean = (F.col("no") + F.col("yes")) / (of(0) + of(1))
        z = F.abs(F.col("yes") / of(1) - F.col("no") / of(0)) / F.sqrt(mean * (1 - mean) * (1 / of(0) + 1 / of(1)) + EDGE)
        best = table.withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(z.desc(), "word"))).filter(F.col("place") <= words)
        chosen = sorted({r["word"] for r in best.select("word").collect()})  # `words` rows a label
    at = {w: i for i, w in enumerate(chosen)}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(t.as_py()) for t in batch.column(0)]
            places = [[at[w] for w in held if w in at] for held, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([s for _, s in found], pa.list_(pa.float64())), pa.array(places, pa.list_(pa.int32())), *[batch.column(i) for i in range(1, 1 + len(ys))]], names=["shape", "places", *ys])

    size = SHAPES + len(chosen)
    weights, bias = np.zeros((size, len(targets))), np.zeros(len(targets))
    centre, scale = np.zeros(SHAPES), np.ones(SHAPES)
    for i, y in enumerate(ys):
        p = (counts[y] + 1) / (counts[f"n{y}"] + 2)
        bias[i] = np.log(p / (1 - p))
    if both:
        table = sample.mapInArrow(rows_of, "shape array<double>, places array<int>, " + ", ".join(f"{y} int" for y in ys)).toPandas()  # the bounded sample
        shape = np.array(table["shape"].tolist())
        centre, scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), EDGE)
        x = np.zeros((len(table), size), np.float32)
        x[:, :SHAPES] = (shape - centre) / scale
        for row, places in enumerate(table["places"]):
            x[row, SHAPES + np.asarray(places, int)] = 1
        for i in both:
            known = table[ys[i]].notna().to_numpy()
            weights[:, i], bias[i] = _fit(x[known], table[ys[i]][known].to_numpy(np.float32), penalty)
    return Evidence(targets, chosen, centre, scale, weights, bias)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.log(p / (1 - p))


def _prior_weight(sums: DataFrame, within: float, n: float, level: str) -> float:
    """How many documents a level's prior weighs: variance within sites over variance between them (method of moments).

    sums has n, s (documents and sum of chances) of each site and m, the mean of the level above. One row is read.
    """
    r = sums.agg(F.count("*").alias("k"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("m")) ** 2).alias("spread"), F.sum(F.col("n").cast("double") ** 2).alias("square")).first()
    if not r["k"] or r["k"] < 2 or n - r["square"] / n <= 0:
        return MOST_PRIOR
    between = (r["spread"] - (r["k"] - 1) * within) / (n - r["square"] / n)
    return min(MOST_PRIOR, within / between) if between > 0 else MOST_PRIOR


def site_posteriors(evidence: DataFrame, p: str, host: str = "host", path: str = "path") -> DataFrame:
    """Replaces p by the chance that takes the document's site into account, and adds <p>_host and <p>_path.

    A host's posterior shrinks the mean chance of its documents to the mean of all, a path's shrinks that of its
    documents to its host's posterior; both leave out the document itself. The path's posterior takes the place of the
    global prior in the document's odds. Sums are grouped by path first, then by host, so a hot host is one sum for each
    task; null hosts and paths are sites of their own.
    """
    paths = written(evidence.groupBy(F.col(host).alias("__h"), F.col(path).alias("__q")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("ss")), "paths")
    hosts = written(paths.groupBy("__h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")), "hosts")
    every = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
    n = float(every["n"] or 0)
    mean = every["s"] / n if n else 0.5
    # variance of single documents around their path's mean
    inside = paths.agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("v"), F.sum(F.col("n") - 1).alias("f")).first()
    within = max(EDGE, (inside["v"] or 0.0) / max(1.0, float(inside["f"] or 0)))
    k_host = _prior_weight(hosts.withColumn("m", F.lit(mean)), within, n, "host")
    means = hosts.select("__h", (F.col("s") / F.col("n")).alias("m"))
    k_path = _prior_weight(paths.join(means, paths["__h"].eqNullSafe(means["__h"])).select("n", "s", "m"), within, n, "path")
    sums = hosts.select(F.col("__h").alias("__hh"), F.col("n").alias("__nh"), F.col("s").alias("__sh"))
    both = written(paths.join(sums, F.col("__h").eqNullSafe(F.col("__hh"))).select("__h", "__q", F.col("n").alias("__np"), F.col("s").alias("__sp"), "__nh", "__sh"), "sites")
    df = evidence.join(small(both, 100_000), F.col(host).eqNullSafe(F.col("__h")) & F.col(path).eqNullSafe(F.col("__q")))
    of_host = (k_host * mean + F.col("__sh") - F.col(p)) / (k_host + F.col("__nh") - 1)
    of_path = (k_path * F.col(f"{p}_host") + F.col("__sp") - F.col(p)) / (k_path + F.col("__np") - 1)
    df = df.withColumn(f"{p}_host", of_host).withColumn(f"{p}_path", of_path)
    odds = _logit(F.col(p)) + _logit(F.col(f"{p}_path")) - _logit(F.lit(mean))
    return df.withColumn(p, 1 / (1 + F.exp(-odds))).drop("__h", "__q", "__np", "__sp", "__nh", "__sh")


def classify(docs: DataFrame, model: Evidence, host: str = "source", path: str = "lang", text: str = "text", key: str = "doc_id", least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """Per document: key, held_out, p_quality and p_toxic with their host and path posteriors, kept.

    kept: the text has a word, p_quality reaches least_quality and p_toxic lies below most_toxic. host and path name the
    columns of the site; a table with URLs gets them from site_levels(). A null or empty text and one without a word are
    not kept; very long texts are read whole; repeated rows are judged each for itself; an empty table gives an empty
    result; other columns are not read. With no labels to learn from both chances are their priors.
    """
    picked = docs.select(F.col(key).alias("__key"), F.col(text).alias("__body"), F.col(host).alias("__host"), F.col(path).alias("__path"))
    df = written(model.apply(picked, "__body"), "evidence")
    for p in ("p_quality", "p_toxic"):
        df = written(site_posteriors(df, p, "__host", "__path"), p)
    kept = ~F.col("__empty") & (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic)
    return df.select(F.col("__key").alias(key), held_out("__key").alias("held_out"), *[f"{p}{x}" for p in ("p_quality", "p_toxic") for x in ("", "_host", "_path")], kept.alias("kept"))
