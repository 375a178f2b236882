"""The operators on single documents against plain versions."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepweave.llm import fertility, language, lexicon_bpe, pii, queries, secrets
from tests.llm import brute

FILES = queries.vocabulary("byte_bpe_50k.tiktoken"), queries.vocabulary("piece_bpe_32k.model"), queries.RANKS_PATTERN
BPE = queries.vocabulary("word_bpe_49k.json")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_fertility_base(which, request):
    docs = request.getfixturevalue(which)
    texts, found = texts_of(docs), fertility.judge(docs, FILES).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        assert tuple(r[1:7]) == brute.base_counts(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def _measures(text, tool, model):
    """The measures from whole texts: white space aside, the piece model's byte tokens are those of the whole text."""
    ids = tool.encode_ordinary(text)
    if not ids:
        return 0, 0.0, 0.0, 0.0
    counts = Counter(ids)
    bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
    white = {f"<0x{ord(c):02X}>" for c in fertility.WHITE}
    spelled = sum(model.is_byte(i) and model.id_to_piece(i) not in white for i in model.encode(text))
    return len(ids), len(text) / len(ids), spelled / max(1, len(text.encode())), bits


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_fertility_measures_and_verdict(which, request):
    import base64

    import sentencepiece
    import tiktoken

    docs = request.getfixturevalue(which)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILES[0], "rb"))}
    tool = tiktoken.Encoding("own", pat_str=FILES[2], mergeable_ranks=ranks, special_tokens={})
    model = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "text", "lang").collect()}
    found = fertility.judge(docs, FILES, lang="lang", weight=5).collect()
    passed, by = {}, {}
    for r in found:
        n, chars, share, bits = _measures(rows[r["doc_id"]]["text"] or "", tool, model)
        assert (r["n_tokens"], r["chars_per_token"]) == (n, pytest.approx(chars)), r["doc_id"]
        assert (r["fallback_share"], r["token_entropy"]) == (pytest.approx(share), pytest.approx(bits)), r["doc_id"]
        lang, octave = rows[r["doc_id"]]["lang"], min(fertility.OCTAVES, n.bit_length())
        band = fertility.BANDS.get(lang) or fertility.BANDS[r["script"]]
        passed[r["doc_id"]] = not r["base_failed"] and n > 0 and band.least_chars <= chars <= band.most_chars and share <= band.most_fallback and bits >= min(band.least_entropy, 0.5 * math.log2(n))
        if passed[r["doc_id"]]:
            for name in (f"lang:{lang}",) * (lang is not None) + (f"script:{r['script']}", "all"):
                by.setdefault((name, octave), set()).add((n, round(chars, 3), round(bits, 3)))
    for r in found:
        octave, lang = min(fertility.OCTAVES, r["n_tokens"].bit_length()), rows[r["doc_id"]]["lang"]
        want = passed[r["doc_id"]]
        if want:
            fence = None
            for name in ("all", f"script:{r['script']}", f"lang:{lang}"):
                if not (group := by.get((name, octave))):
                    continue
                (a, m, c), (d, _, e) = (np.percentile([x[i] for x in group], [25, 50, 75]) for i in (1, 2))
                wider = 1 + 5 / len(group) if name == "all" else 1
                own = np.array([a - 2 * wider * max(c - a, 0.02 * m), c + 2 * wider * max(c - a, 0.02 * m), d - 2 * wider * max(e - d, 0.1)])
                fence = own if fence is None else (len(group) * own + 5 * fence) / (len(group) + 5)
            edge = np.abs(np.array([r["chars_per_token"], r["chars_per_token"], r["token_entropy"]]) - fence).min()
            if edge < 1e-6:
                continue
            want = fence[0] <= r["chars_per_token"] <= fence[1] and r["token_entropy"] >= fence[2]
        assert r["kept"] == want, r["doc_id"]


def test_fertility_bands_reject_noise(spark):
    good = "It is a truth that the people of the town would often walk along the river in the evening and talk about their day at work. " * 1
    noise = " ".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(30))
    rows = fertility.judge(spark.createDataFrame([(1, good + good[::2]), (2, noise), (3, " ".join(["x"] * 25))], "doc_id long, text string"), FILES).collect()
    verdict = {r["doc_id"]: r["kept"] for r in rows}
    assert verdict[1] and not verdict[3]


def test_fertility_rejects_gibberish(spark):
    import base64
    import random

    noise = [" ".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(30)), " ".join(base64.b64encode(hashlib.sha512(bytes([i])).digest()).decode() for i in range(30))]
    r = random.Random(5)
    noise += [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 9))) for _ in range(60)), " ".join(str(r.randrange(10**6, 10**7)) for _ in range(60))]
    rows = fertility.judge(spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string"), FILES).collect()
    assert len(rows) == 4 and not any(x["base_failed"] or x["kept"] for x in rows)


def test_fertility_fences_follow_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000 and length(text) < 20000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    found = fertility.judge(docs, FILES, lang="lang").join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r["quality"]: r["kept"] for r in found}
    assert kept[1] > 0.98 and kept[0] < 0.5


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_personal_data_base(which, request):
    docs = request.getfixturevalue(which)
    texts = texts_of(docs)
    found = pii.digest(pii.find(docs)).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        base = brute.spans(texts[r["doc_id"]], brute.PERSONAL, by_start=False)
        assert r["base_sha256"] == brute.digest(base), (r["doc_id"], base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        listed = r["spans"].split(",") if r["spans"] else []
        assert listed[: len(base)] == [f"{k}:{a}:{b}" for k, a, b in base]


def test_terms_at_a_texts_begin_and_end_are_evidence(spark):
    """Only a word that the window cuts is left out: not the first or the last one of a text."""
    rows = [(i, f"Zebrafish a0@x.org {chr(97 + i) * 3}") for i in range(5)] + [(10 + i, f"{chr(97 + i) * 3} b@x.org quagga") for i in range(5)] + [(20 + i, f"day {i} in town") for i in range(40)]
    found = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {"zebrafish": pytest.approx(1), "quagga": pytest.approx(1)}
    far = [(i, f"{'x' * 40} cutword{'y' * 35} {chr(97 + i) * 20} c@x.org and more") for i in range(5)] + rows[10:]
    assert not any("ord" in r["term"] for r in pii.disclosing_terms(spark.createDataFrame(far, "doc_id long, text string")).collect())


def test_rows_without_a_key_keep_their_own_terms(spark):
    rows = [(None, f"zorblatt {i} x{i}@y.org qwert{i % 3}") for i in range(9)] + [(None, None)] * 3 + [(None, f"day {i} in the town") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df)
    assert found.count() == len(rows) and all(set(t["hit"] for t in r["__terms"]) <= set((r["text"] or "").split()) for r in found.collect())


def test_disclosing_terms_are_replaced(spark):
    rows = [(i, f"report {chr(97 + i) * 3} zorblatt met x@y.org in {chr(98 + i) * 4} today") for i in range(6)]
    rows += [(10 + i, f"report of the day {i} in town") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(pii.find(docs)).collect()}
    assert "zorblatt" not in clean[0] and "x@y.org" not in clean[0] and "<EMAIL>" in clean[0]
    assert clean[10] == rows[6][1] and "report" in clean[0]
    terms = {r["term"]: r for r in pii.disclosing_terms(docs).collect()}
    assert abs(terms["zorblatt"]["disclosure"] - 1) < 1e-9 and terms["zorblatt"]["removed"] and "report" not in terms


def test_disclosure_by_counting(spark, documents):
    names = ["kestrel", "plover", "heron", "dunlin"]
    rows = [f"note {i} from {names[i % 4]} at {names[i % 4]}@x.org about thing{i % 7} and more thing{i % 5}" for i in range(60)]
    rows += [f"the {names[i % 4]} of day {i}" for i in range(12)] + rows[:9] + [None, "", "call +1 202 555 0100 kestrel or plover@x.org heron"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    want = brute.disclosing([r["text"] for r in docs.collect()], 60, 3, 0.4)
    found = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing_terms(docs, generalise=0.4).collect()}
    assert set(found) == set(want) and len(found) > 4
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_secrets_base(which, request):
    docs = request.getfixturevalue(which)
    texts = texts_of(docs)
    found = secrets.digest(secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        base = brute.spans(texts[r["doc_id"]], brute.SECRET, by_start=True)
        assert r["base_sha256"] == brute.digest(base), (r["doc_id"], base)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(b[0] == k for b in base) for k in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_markov_tells_random_from_ordinary(spark, documents):
    model = secrets.train(secrets.labelled_samples(documents))
    rows = [(1, "q8Zr3LmX0vB7tYw2Kp9s_HdJ4"), (2, "internationalisation2andthethere"), (3, "the_ordinary_and_there_the_thing1")]
    found = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model)).collect()}
    assert found[1].startswith("markov:0:25") and found[2] == found[3] == ""


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_markov_spans_by_plain_scoring(which, request, documents):
    docs = request.getfixturevalue(which)
    model = secrets.train(secrets.labelled_samples(documents))
    n, texts = len(secrets.ALPHABET), texts_of(docs)
    token = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
    for r in secrets.digest(secrets.scan(docs, model)).collect():
        text = texts[r["doc_id"]] or ""
        base = brute.spans(text, brute.SECRET, by_start=True)
        more = []
        for m in token.finditer(text):
            at = [secrets.ALPHABET.index(c) for c in m[0]]
            ratio = sum(round(model[a * n + b], 6) for a, b in zip(at, at[1:]))
            clear = not any(a < m.end() and m.start() < b for _, a, b in base)
            if clear and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and ratio >= max(12.0, 0.7 * len(m[0])):
                more.append(("markov", m.start(), m.end()))
        assert {f"{k}:{a}:{b}" for k, a, b in base + more} == set(filter(None, r["spans"].split(","))), r["doc_id"]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_language_by_plain_distances(which, request, documents):
    docs, known = request.getfixturevalue(which), {}
    for r in documents.collect():
        if r["lang"] is not None and r["text"] is not None and not brute.held_out(r["doc_id"]):
            known.setdefault(r["lang"], Counter()).update(brute.ngrams(r["text"]))
    profiles = {lang: brute.rank_profile(counts, 400) for lang, counts in known.items()}
    learned = language.learn(documents)
    decode = lambda code: "".join(chr(x) for x in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if x)
    assert {lang: [decode(g) for g in found] for lang, found in learned.items()} == {lang: list(p) for lang, p in profiles.items()}
    texts = texts_of(docs)
    for r in language.predict(docs, learned).collect():
        want = brute.out_of_place(texts[r["doc_id"]], profiles, 400)
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1]), r["doc_id"]


def test_language_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "abc abd"), (1, "abc abd"), (None, "abc"), (None, "7")], "doc_id long, text string")
    one = [int(g) for g in language.grams("abc")[0]]
    found = [(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, {"zz": one, "aa": one}).collect()]
    assert found == [(1, "aa"), (1, "aa"), (None, "aa"), (None, "und")]


def test_language(documents, none, odd):
    found = language.predict(documents, language.learn(documents)).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["lang_pred"] != "und" and len(r["text"]) > 60]
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) for r in found)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)
    for r in language.predict(odd, language.learn(documents)).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")), r["doc_id"]
    assert language.predict(none, language.learn(none)).count() == 0
    assert {r["lang_pred"] for r in language.predict(documents, {}).collect()} == {"und"}


def test_language_ignores_labels_of_what_it_predicts(documents):
    docs = documents.select("doc_id", "text", "lang")
    swapped = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    key = lambda d: sorted(map(tuple, language.predict(d, language.learn(d)).collect()))
    assert key(docs) == key(swapped)


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_bpe(which, request, spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(BPE)
    tool.no_truncation()
    tool.no_padding()
    docs = request.getfixturevalue(which)
    texts = texts_of(docs)
    lexicon = lexicon_bpe.compile_lexicon(spark, lexicon_bpe.count_words(docs, BPE), BPE)
    found = lexicon_bpe.code(docs, BPE, lexicon).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        ids = tool.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids), r["doc_id"]
        assert r["ids_sha256"] == brute.sha256(" ".join(map(str, ids))), r["doc_id"]
        assert r["decoded_sha256"] == brute.sha256(tool.decode(ids, skip_special_tokens=False)), r["doc_id"]


def test_lexicon_round_trip(tmp_path):
    words = [w.encode() for w in ("a", "ab", "abc", "bc", "xbc", "été", "zzzz", "b" * 40)]
    path = str(tmp_path / "lexicon")
    lexicon_bpe.build([(w, [i, i + 1]) for i, w in enumerate(words)], path)
    tool = lexicon_bpe.Lexicon(path)
    assert [tool.find(w) for w in words] == [[i, i + 1] for i in range(len(words))]
    assert tool.find(b"") is None and tool.find(b"abcd") is None and tool.find(b"xb") is None
    assert os.path.getsize(path) < 1500


def test_every_code_point_is_split_as_by_the_library():
    """Alone between letters, and twice in a row beside a mark: newer tables of the pattern package make no difference."""
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), lexicon_bpe.Coder(lexicon_bpe.Vocabulary(path), None)
    library.no_truncation()
    library.no_padding()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    wrong = []
    for i in range(0, len(points), 50_000):
        texts = [f"a{c}b!{c}{c}!" for c in points[i : i + 50_000]]
        for c, t, e in zip(points[i:], texts, library.encode_batch(texts, add_special_tokens=False)):
            if own.encode(t)[1] != " ".join(map(str, e.ids)):
                wrong.append(hex(ord(c)))
    assert wrong == []


def test_files_of_another_kind_are_refused(tmp_path):
    import json

    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"model": file["model"] | {"end_of_word_suffix": ""}}, {"model": file["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            lexicon_bpe.refused(file | change, "x")
    lexicon_bpe.refused(file, "x")
    big = [(f"w{i}".encode(), [i, 70_000 + i]) for i in range(300)]
    lexicon_bpe.build(big, str(tmp_path / "lexicon"))
    found = lexicon_bpe.Lexicon(str(tmp_path / "lexicon"))
    assert all(found.find(w) == ids for w, ids in big)
