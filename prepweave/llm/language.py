"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.llm.common import drawn, written

SPACE = 0x20
#: Documents whose crc32 of the key, as text, leaves this remainder by FOLDS are held out from learning.
FOLDS, HELD = 4, 2


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 characters of a text's lower-case words, with a space before and after each word, and how
    often each stands there. An n-gram is one integer: 21 bits a character, the first one highest."""
    points = _letters()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    blank = points == SPACE
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    blank = points == SPACE
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = points[~blank] << 42
    two = (points[:-1] << 42) | (points[1:] << 21)
    three = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[~blank[1:-1]]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_lang: int = 3000, size: int = 400) -> dict[str, list[int]]:
    """Per language its `size` most frequent n-grams in order of rank.

    Learns only from documents that are not held out and whose lang and text are not null. About rows_per_lang of them
    are used per language, by a hash of the key (the documented bound of the labelled sample). The result has one
    profile per value of lang, so it does not grow with the documents. Without such documents it is empty.
    """
    known = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    shares = known.groupBy("lang").agg((F.lit(float(rows_per_lang)) / F.count("*")).alias("share"))
    shares = written(shares, "shares")
    picked = known.join(F.broadcast(shares) if shares.count() <= 10_000 else shares, "lang").filter(drawn(F.col("share"), "key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for t, lg in zip(batch.column(0), batch.column(1)):
                by.setdefault(lg.as_py(), []).append(grams(t.as_py()))
            for lg, found in by.items():
                codes, which = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                sums = np.bincount(which, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lg] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], names=["lang", "gram", "n"])

    counts = picked.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in ranked.select("lang", "rank", "gram").orderBy("lang", "rank").collect():  # size rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Profiles:
    """Language profiles ready for lookup."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names = sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(profiles[name], np.int64) for name in self.names])) if self.names else np.empty(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.codes)), 1 << 40)  # far from any place: the profile lacks the n-gram
        for of, name in zip(self.ranks, self.names):
            of[np.searchsorted(self.codes, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))
        self.most = size

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance, ties to the first name; an n-gram that a profile lacks counts
        `most`. The score is the language's likeness (1 - distance / largest distance) in the sum of all likenesses."""
        if text is None or not self.names:
            return "und", 0.0
        codes, counts = grams(text)
        if not len(codes):
            return "und", 0.0
        own = top(codes, counts, self.most)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == own)
        away = np.minimum(np.abs(self.ranks[:, at[place]] - place), self.most).sum(axis=1) + self.most * (len(own) - len(place))
        likeness = list(1.0 - away / (self.most * len(own)))
        best = int(np.argmax(likeness))
        total = sum(likeness)
        return self.names[best], float(likeness[best] / total) if total > 0 else 0.0


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", key: str = "doc_id", size: int = 400) -> DataFrame:
    """Per document: key, held_out, lang_pred, score (0 to 1).

    lang_pred is a learned language, or `und` with score 0 if the text is null or has no letter, or nothing was learned.
    The profiles (some hundred numbers a language) go to the workers with the function. Repeated rows are predicted each
    for itself; a null key is not held out; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Profiles(profiles, size)
        for batch in batches:
            found = [tool.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    picked = docs.select(F.col(key).alias(key), held_out(key).alias("held_out"), F.col(text).alias("text"))
    kind = dict(picked.dtypes)[key]
    return picked.mapInArrow(run, f"{key} {kind}, held_out boolean, lang_pred string, score double")


def assign(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", lang: str = "lang", size: int = 400) -> DataFrame:
    """The documents with `lang` replaced by the predicted language (see predict()); the other columns stay as they are."""
    schema = docs.schema
    place, target = schema.names.index(text), schema.names.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Profiles(profiles, size)
        for batch in batches:
            found = pa.array([tool.predict(t.as_py())[0] for t in batch.column(place)], pa.string())
            yield batch.set_column(target, lang, found)

    return docs.mapInArrow(run, schema)
