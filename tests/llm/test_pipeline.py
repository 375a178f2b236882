"""The pipeline's stages against plain versions, each on what the one before kept."""

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from prepweave.llm import mixing, neardup, queries
from prepweave.llm.common import written
from tests.llm import brute


def test_stages(spark, documents, sf):
    columns = documents.columns
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    docs, steps = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        steps[name] = rows(docs)
        if name != "token_ids":
            assert docs.columns == columns
    first = rows(documents)
    kept = steps["language_id"]
    assert set(kept) == {k for k, r in first.items() if any(c.isalpha() for c in r["text"] or "")}
    assert all(kept[k]["text"] == first[k]["text"] for k in kept)
    groups = brute.near_duplicates({k: r["text"] for k, r in kept.items()})
    assert set(steps["near_duplicates"]) == {k for k, (_, _, stays) in groups.items() if stays}
    assert all(steps["near_duplicates"][k] == kept[k] for k in steps["near_duplicates"])
    clean = steps["personal_data"]
    assert set(clean) == set(steps["near_duplicates"])
    for k, r in clean.items():
        before = steps["near_duplicates"][k]["text"]
        if not brute.spans(before, brute.PERSONAL, False):
            continue
        assert not any(kind == "email" for kind, *_ in brute.spans(r["text"], brute.PERSONAL, False)), k
    mixed = steps["mix_sources"]
    assert mixed and set(mixed) <= set(clean)
    for k, r in mixed.items():
        have, took = set(brute.WORD.findall(clean[k]["text"])), brute.WORD.findall(r["text"])
        assert took and set(took) <= have and len(took) <= 2 * len(brute.WORD.findall(clean[k]["text"])) and r["n_chars"] == len(r["text"])
    tool = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    last = steps["token_ids"]
    assert set(last) == set(mixed)
    for k, r in last.items():
        ids = tool.encode(mixed[k]["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), brute.sha256(" ".join(map(str, ids))))


def test_empty(spark, none, sf):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_null_and_repeated_doc_ids(spark, sf):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    near = text(0).replace("w0x7 ", "other ")
    rows = [(None, text(0), "s1"), (None, near, "s2"), (None, text(1), "s1"), (7, text(2), "s1"), (7, text(3), "s1"), (8, text(2), "s2"), (9, text(4), "s1"), (9, text(4), "s1")]
    docs = spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(rows) and all(r["kept"] == (r["doc_id"] != 8) for r in found)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    assert len(kept) == 5 and {(None, text(1)), (7, text(2)), (7, text(3)), (9, text(4))} < set(kept) and {(None, text(0)), (None, near)} & set(kept)
    assert sorted(map(str, kept)) == sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(5), sf).collect())
    _, pieces = mixing.mix(docs)
    mixed = mixing.mixed_texts(docs, pieces).collect()
    took = {r["row"]: 0 for r in pieces.collect()}
    assert sum(len(r["text"].split()) for r in mixed) == pieces.agg({"words": "sum"}).first()[0]
    assert len({r["text"].split()[0].split("x")[0] for r in mixed if r["doc_id"] is None}) == 2 and len(took) >= 6
    assert all(len({w.split("x")[0] for w in r["text"].split()} - {"other"}) == 1 for r in mixed)


def test_stages_on_odd_rows(spark, odd, documents, sf):
    """Nulls, empty and very long texts, repeated rows and columns of clashing names, through each stage."""
    docs = odd.unionByName(odd.limit(9)).unionByName(documents, allowMissingColumns=True)
    docs = docs.withColumns({c: F.lit("clash") for c in ("__text", "__key", "row", "component", "grp", "planes")})
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = written(stage(spark, docs, sf), name)
        assert 0 < docs.count() <= before
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
