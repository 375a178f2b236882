"""A corpus pipeline: language, near-duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of `documents`, and so has the
result of each stage but the last. Every stage works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepweave.llm import language, lexicon_bpe, mixing, neardup, pii
from prepweave.llm.common import written
from prepweave.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars is that of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter in the text) go; lang becomes the predicted one.

    An input whose rows have no label at all has nothing to learn from, so all its documents go.
    """
    profiles = language.learn(docs)
    return _documents(language.assign(docs, profiles).filter("lang <> 'und'"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; rows that repeat it stay one row. Null and repeated
    doc_ids are documents like others."""
    return _documents(neardup.one_of_each(docs.select(*COLUMNS)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in the texts are replaced; all documents stay."""
    return _documents(pii.sanitise(pii.find(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text becomes the words that the mix takes of it, up to twice; documents of which it takes none go."""
    _, pieces = mixing.mix(docs)
    return _documents(mixing.mixed_texts(docs, pieces))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and the hashes of ids and decoded text."""
    path = vocabulary("word_bpe_49k.json")
    lexicon = lexicon_bpe.compile_lexicon(spark, lexicon_bpe.count_words(docs, path), path)
    return lexicon_bpe.code(docs, path, lexicon)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]
#: Rank-order profiles, minwise hashes and merges have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
