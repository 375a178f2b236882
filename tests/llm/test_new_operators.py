"""Toxicity, the conversations' trie and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from prepweave import tables
from prepweave.llm import prefix_trie, resample, toxicity
from prepweave.llm.common import drawn



# --- importance resampling


def _features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _resampled(docs, target, share=(5, 100), least=20):
    found = [_features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in _features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    rows = []
    for place, ((key, _), (words, f)) in enumerate(zip(docs, found)):
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least, place])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[6]))
    for i, r in enumerate(able[: len(able) * share[0] // share[1]]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def _same(a, b):
    return sorted(map(repr, map(tuple, a))) == sorted(map(repr, b))


def test_resample_odd(odd, odd_rows, spark):
    target = ["the same eight words", None, "ONE two Three", ""]
    docs = [(r[0], r[1]) for r in odd_rows]
    for share, least in (((5, 100), 20), ((1, 2), 1), ((1, 1), 0)):
        found = resample.resample(odd, spark.createDataFrame([(t,) for t in target], "text string"), share=share, least_words=least)
        assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and _same(found.collect(), _resampled(docs, target, share, least))


def test_resample_repeats_and_null_keys(spark):
    text = " ".join(f"Word{i % 7} ÄB" for i in range(40))
    rows = [(None, text)] * 5 + [(3, text)] * 4 + [(i, f"other {i} words " * 9) for i in range(20)]
    found = resample.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(text,)], "text string"), share=(1, 3))
    got = found.collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 10))
    assert _same([(r[0], r[1], r[2], r[3]) for r in got], [r[:4] for r in _resampled(rows, [text])])


def test_resample_empty(none, odd, spark):
    target = spark.createDataFrame([], "text string")
    assert resample.resample(none, target).collect() == []
    assert resample.resample(odd, target).count() == odd.count()


def test_runs_need_no_shuffle_of_words(documents):
    plan = resample.position_runs(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Window") < plan.index("Generate") < plan.index("Exchange")


# --- conversations


def _nodes(convs):
    """Nodes of the trie of {conv: turns}, by their keys."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = Counter(), Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        saved[k] += (len(members[k]) - 1) * k[-1][2] if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    hashed = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashed(ends[k])) for k, m in members.items()]


def _string(turns):
    return b"".join(hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16] + n.to_bytes(8, "big") for r, t, n in turns)


def _turn(text):
    return "u", text, len(text.split())


@pytest.mark.parametrize("seed", range(4))
def test_trie_of_small_runs_and_ranges(seed, spark):
    """Runs of a few rows, blocks of one or two and many ranges, so that edges and merges happen everywhere."""
    r = random.Random(seed)
    pool = [tuple(_turn(f"{x} " * r.randint(0, 3)) for x in r.choices("abc", k=r.randint(0, 6))) for _ in range(60)]
    hot = pool[0] + (_turn("hot one"),) * 9
    convs = {r.randint(-(10**6), 10**6) * r.choice((1, 10**9)): hot if r.random() < 0.4 else r.choice(pool) for _ in range(400)}
    df = spark.createDataFrame([(c, bytearray(_string(t))) for c, t in convs.items()], "conv long, seq binary").repartition(5)
    found = prefix_trie.prefix_trie(df, run_bytes=3_000, block_bytes=300, range_bytes=2_000, least_ranges=1 + 12 * seed)
    assert found.columns == prefix_trie.OUT and _same(found.collect(), _nodes(convs))


def _conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("clash") for c in ("seq", "conv", "n", "first", "part", "range", "parent", "head", "h", "hex", "one", "all")})


def test_conversations_odd(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", None, ""]), r.choice(["a b", "", None, "c" * 50_000, " \t\n"])) for c in (0, 1, 2, 19, 20, 25, -3, 45, 10**15 + 1) for t in (None, 0, 0, 1, 2**40) if r.random() < 0.8]
    rows += [(None, 1, "user", "no conversation")] * 3 + rows[:4]
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            one = (role or "", text or "", len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
            turns[c].append((t is not None, t or 0, _string([one]), one))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    found = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.strings(_conversations(spark, rows)))).collect()
    assert _same(found, _nodes(rebuilt))


def test_conversations_empty(spark):
    for rows in ([], [(None, 0, "user", "x")]):
        assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.strings(_conversations(spark, rows)))).collect() == []


def test_turnless_conversations(spark):
    """A conversation whose only turn is replaced by an absent one's belongs to the root alone."""
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    found = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.strings(_conversations(spark, [(c, 0, "user", "x")])))).collect()
    assert _same(found, _nodes({c: ()}))


def test_merge_looks_at_shared_turns_once(monkeypatch):
    """Turns that are known to be shared are not compared again: each output row costs few turns however long it is."""
    looked = []
    whole = prefix_trie.shared_turns
    monkeypatch.setattr(prefix_trie, "shared_turns", lambda a, b, known=0: looked.append((n := whole(a, b, known)) - known) or n)
    seqs = sorted(_string([_turn("same")] * 50 + [_turn(str(i))]) for i in range(64))
    block = lambda rows, name: {"run": name, "lcp": [0] + [50] * (len(rows) - 1), "rest": [rows[0]] + [x[50 * 24 :] for x in rows[1:]], "part": [0] * len(rows), "n": [1] * len(rows), "first": [0] * len(rows), "ids": ["0"] * len(rows)}
    runs = [prefix_trie.Run(block(seqs[i::8], str(i))) for i in range(8)]
    found = list(prefix_trie.merge(runs, lambda name: None))
    assert [x[0] for x in found] == seqs and [x[1] for x in found] == [0] + [50] * 63
    assert sum(looked) <= 50 * 8  # the first round only; comparing all anew would look at some 50 * 64 * 3 turns


# --- toxicity


def _labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity_on_held_out(spark):
    docs, labels = _labelled(spark, "/root/testdata/sf0.1")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    y, p = rows["toxic"].to_numpy() > 0, rows["predicted"].to_numpy() > 0
    places = rows["score"].rank().to_numpy()
    auc = (places[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc >= 0.95 and (y & p).sum() >= 0.8 * y.sum() and (~y & p).sum() <= 0.03 * (~y).sum()


def _network(seed):
    """Large weights, so that no filter's value is cut off."""
    net, r = toxicity.Network(seed), np.random.default_rng(seed)
    net.table[: toxicity.SLOTS] = r.normal(0, 1, (toxicity.SLOTS, toxicity.SIZE))
    net.shifts[:] = 0
    net.out[:] = r.normal(0, 1, toxicity.POOLED)
    return net


def test_stretches_are_whole_texts():
    """A text's pooled values are those of one pass over all its words, whatever stretches and batches it is scored in."""
    net = _network(3)
    r = random.Random(2)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(3_000)]
    texts = [" ".join(r.choices(words, k=n)) for n in (0, 1, 2, 5, 300, 2 * toxicity.STRETCH + 1, 7, toxicity.STRETCH, toxicity.STRETCH - 1, 3)] + [None, "12 !!"]
    found = toxicity.Scorer(net).logits(texts)
    rows = [np.array([toxicity.slots(w) for w in toxicity.words_of(t)], np.int64).reshape(-1, toxicity.PARTS) for t in texts]
    assert len(set(found.tolist())) > 8 and np.allclose(found, [toxicity._logits(net, [x])[0] for x in rows], atol=1e-3)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 8)
    monkeypatch.setattr(toxicity, "REMEMBERED", 40)
    net, texts = _network(1), [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(a, a + 13)) for a in range(0, 400, 9)]
    one = toxicity.Scorer(net)
    assert np.allclose(one.logits(texts), [toxicity.Scorer(net).logits([t])[0] for t in texts], atol=1e-4) and len(one.at) <= 42


@pytest.mark.parametrize("which", ["odd", "none"])
def test_toxicity_odd(which, request, spark):
    docs = request.getfixturevalue(which)
    labels = spark.createDataFrame([(10, 1), (13, 0), (4, 0), (19, 1), (19, 0), (None, 1), (99999, 1), (7, None)], "doc_id long, toxic int").withColumn("score", F.lit("clash"))
    for some in (labels, labels.limit(0), labels.filter("toxic = 0")):
        found = toxicity.score(docs, toxicity.learn(docs, some)).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """Whatever a task trains on, all labelled documents that are not held out count, for evidence, network and thresholds."""
    docs = spark.createDataFrame([(i, f"w{i % 50} " + ("vile" if i % 3 == 0 else "kind") + " more", "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 1, 0) as toxic")
    seen = []
    begin = toxicity.Network.begin
    monkeypatch.setattr(toxicity.Network, "begin", lambda self, n, yes, count, positive: (seen.append((n.max(), count)), begin(self, n, yes, count, positive)))
    model = toxicity.learn(docs, labels, rows=40)
    learned = docs.filter(~toxicity.held_out("doc_id")).count()
    assert 0.6 * learned < seen[0][1] < 0.9 * learned and seen[0][0] == seen[0][1]  # "more" is in all but those that are kept back
    found = toxicity.score(docs, model).join(labels, "doc_id")
    assert found.filter("predicted <> toxic").count() == 0


def test_training_leaves_documents_where_they_lie(spark, monkeypatch):
    """No step of the training shuffles documents: only sums by row of the embedding table cross the net."""
    texts = [" ".join(f"w{i * k % 97}" for k in range(2, 9)) + (" vile" if i % 3 == 0 else "") for i in range(120)]
    table = spark.createDataFrame(list(zip(map(bytearray, toxicity.rows_by_text(texts)), [int(i % 3 == 0) for i in range(120)], range(120))), "rows binary, y int, h long").repartition(4)
    plans, collected = [], type(table).toPandas
    monkeypatch.setattr(type(table), "toPandas", lambda self: (plans.append(self._jdf.queryExecution().sparkPlan().toString()), collected(self))[1])
    net = toxicity._trained(tables.written(table, "test"), 120, 40, 30, 12, 0.2)
    assert len(plans) == 1 + toxicity.MIXES and not any("FlatMapGroups" in p or "Repartition" in p for p in plans)
    logits = toxicity.Scorer(net).logits(texts)
    assert logits[::3].min() > max(logits[1::3].max(), logits[2::3].max())


def test_groups_are_bounded(monkeypatch):
    """A task trains on all its documents, at most twice `rows` at a time, fewer if they are long."""
    one = lambda i, n: pa.RecordBatch.from_pydict({"h": list(range(i, i + n)), "rows": [b"x" * 80] * n})
    batches = [one(0, 25), one(25, 3), one(28, 10), one(38, 1), one(39, 61)]
    for held, most in ((1 << 28, 20), (900, 10)):
        monkeypatch.setattr(toxicity, "HELD", held)
        groups = [g.column("h").to_pylist() for g in toxicity._groups(iter(batches), 10)]
        assert sum(groups, []) == list(range(100)) and max(map(len, groups)) <= most


def test_words_of_all_texts_at_once(monkeypatch):
    """The words hashed together are those of each text, whatever the stretches; a run of letters over a stretch is several."""
    r = random.Random(5)
    texts = ["".join(r.choices("abÉéßСс中'’ -9\n\t𝐀", k=r.randint(0, 90))) for _ in range(300)] + [None, "", " ", "12", "a" * 64, " a" * 40]
    plain = [regex.findall(r"\p{L}+", (t or "").lower()) for t in texts]
    for stretch in (1 << 15, 64):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        found = [np.frombuffer(x, np.uint16).reshape(-1, toxicity.PARTS).tolist() for x in toxicity.rows_by_text(texts)]
        assert found == [[list(toxicity.slots(w)) for w in words] for words in plain]
    assert [list(toxicity.words_of(t)) for t in texts] == plain
    whole = {toxicity.slots(w)[:2] for words in plain for w in words}
    assert len(whole) == len({w for words in plain for w in words})
    found = np.frombuffer(toxicity.rows_by_text(["b " + "a" * 150])[0], np.uint16).reshape(-1, toxicity.PARTS).tolist()
    assert found == [list(toxicity.slots(w)) for w in ("b", "a" * 64, "a" * 64, "a" * 22)]


def test_samples_of_small_shares(spark):
    """A share far below one millionth still draws its part, and a share of 1 draws all."""
    ids = spark.range(1 << 20)
    assert ids.filter(drawn(1.0, "id")).count() == 1 << 20
    assert 900 < ids.filter(drawn(1 / 1024, "id")).count() < 1150
    hashes = ids.select((F.xxhash64(F.lit("sample"), "id").bitwiseAND(2**63 - 1)).alias("h")).agg(F.min("h")).first()[0]
    tiny = (hashes + 1) / 2**63  # below 10^-5: holds the least hash
    assert 1 <= ids.filter(drawn(tiny, "id")).count() <= 3 and ids.filter(drawn(tiny / 4, "id")).count() == 0
