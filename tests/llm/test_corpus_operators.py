"""The operators over whole tables against plain versions."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prepweave.llm import knn, mixing, neardup, queries, site_quality, warc
from prepweave.llm.common import shared_dir, written
from prepweave.llm.components import components
from tests.llm import brute


def test_site_quality_on_held_out(documents, spark, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = site_quality.classify(docs, site_quality.learn(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    clean = [r["kept"] for r in rows if r["quality"] and not r["toxic"]]
    low = [r["kept"] for r in rows if not r["quality"]]
    assert sum(clean) >= 0.97 * len(clean) and sum(low) <= 0.2 * len(low)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_site_quality_against_a_plain_version(which, request, spark):
    """Evidence from shapes and words taken character by character, posteriors by lists, the verdict from both."""
    docs = request.getfixturevalue(which)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = site_quality.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    rows = docs.select("doc_id", "text", "source", "lang").collect()
    shapes = [brute.quality_shape(r["text"] or "") for r in rows]
    chances = []
    for k in range(2):
        z = [model.bias[k] + sum((x - c) / s * w for x, c, s, w in zip(shape, model.centre, model.scale, model.shape_weights[:, k])) + sum(model.by_word[w][k] for w in words if w in model.by_word) for words, shape in shapes]
        chances.append(brute.site_chances([brute.logistic(x) for x in z], [r["source"] for r in rows], [r["lang"] for r in rows]))
    found = {r["doc_id"]: r for r in site_quality.classify(docs, model).collect()}
    for r, (words, _), good, toxic in zip(rows, shapes, *chances):
        got = found[r["doc_id"]]
        assert (got["p_quality"], got["p_toxic"]) == (pytest.approx(good, abs=1e-9), pytest.approx(toxic, abs=1e-9)), r["doc_id"]
        if min(abs(good - 0.5), abs(toxic - 0.5)) > 1e-6:
            assert got["kept"] == (bool(words) and good >= 0.5 and toxic < 0.5)


def test_site_posteriors_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(h, q, float(np.clip(0.1 + 0.2 * h + 0.1 * q + rng.normal(0, 0.1), 0.01, 0.99))) for h in range(4) for q in range(3) for _ in range(2 + 5 * h)]
    df = spark.createDataFrame([(i, f"h{h}" if h else None, f"p{q}", p) for i, (h, q, p) in enumerate(rows)], "id long, host string, path string, p double")
    h, q, p = (np.array(x) for x in zip(*rows))
    group = lambda keys: {k: (keys == k) for k in set(keys.tolist())}
    path = h * 3 + q
    within = sum(((p[m] - p[m].mean()) ** 2).sum() for m in group(path).values()) / (len(p) - 12)

    def weight(keys, above):
        sizes = [(m.sum(), p[m].mean(), above[m][0]) for m in group(keys).values()]
        spread = sum(n * (a - b) ** 2 for n, a, b in sizes)
        between = (spread - (len(sizes) - 1) * within) / (len(p) - sum(n * n for n, *_ in sizes) / len(p))
        return within / between if between > 0 else site_quality.MOST_PRIOR

    mean = np.full(len(p), p.mean())
    hosts = np.array([p[h == x].mean() for x in h])
    k_host, k_path = weight(h, mean), weight(path, hosts)
    total = lambda keys: (np.array([p[keys == k].sum() for k in keys]) - p, np.array([(keys == k).sum() for k in keys]) - 1)
    s, n = total(h)
    of_host = (k_host * mean + s) / (k_host + n)
    s, n = total(path)
    of_path = (k_path * of_host + s) / (k_path + n)
    logit = lambda x: np.log(x / (1 - x))
    want = 1 / (1 + np.exp(-(logit(p) + logit(of_path) - logit(mean))))
    got = site_quality.site_posteriors(df, "p").orderBy("id").toPandas()
    assert np.allclose(got["p_host"], of_host) and np.allclose(got["p_path"], of_path) and np.allclose(got["p"], want)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_site_quality_odd(which, request, spark):
    docs = request.getfixturevalue(which)
    labels = spark.createDataFrame([(10, 1, 0), (13, 1, 0), (4, 0, 0), (19, 0, 1), (19, 0, 1), (None, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    found = site_quality.classify(docs, site_quality.learn(docs, labels)).collect()
    assert len(found) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(r["kept"] for r in found if not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
    nothing = site_quality.classify(docs, site_quality.learn(docs, labels.limit(0))).collect()
    assert len(nothing) == len(found)


def test_site_levels(spark):
    df = site_quality.site_levels(spark.createDataFrame([("HTTP://A.org/x/y?z",), ("http://b.org",), (None,)], "url string"), "url")
    assert [tuple(r) for r in df.select("host", "path").collect()] == [("a.org", "x"), ("b.org", ""), (None, None)]


def test_archives_are_read_piece_by_piece():
    """Plain, gzipped as a whole, record by record and followed by padding; records longer than a piece; broken ends."""
    import gzip
    import random

    r = random.Random(1)
    blocks = [bytes(r.choices(range(256), k=k)) for k in (0, 5, 3_000, 1_200_000, 0, 70_000)]
    made = [f"{warc.VERSION}\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(blocks)]
    whole = b"".join(made)
    for data in (whole, gzip.compress(whole), b"".join(map(gzip.compress, made)), gzip.compress(whole) + b"\0" * 99):
        assert [x[-1] for x in warc._parse(data)] == blocks
    assert max(map(len, warc._inflated(gzip.compress(whole), 1 << 16))) <= 1 << 16
    for broken in (whole[:-9], gzip.compress(whole)[:-900]):
        with pytest.raises(ValueError):
            list(warc._parse(broken))
    assert list(warc._parse(b"")) == []


def test_one_payload_on_half_of_the_pages(spark):
    rows = [(i, f"http://x.org/{i}", "" if i % 2 else f"<p>{i}</p>", None) for i in range(400)]
    found = {r["page_id"]: r for r in warc.round_trip(_pages(spark, rows), shared_dir(spark, "warc")).collect()}
    assert len(found) == 400 and found[399]["record_type"] == "response"
    assert all((r["record_type"], r["refers_to"]) == ("revisit", 399) for i, r in found.items() if i % 2 and i < 399)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_values_are_computed_once(spark):
    """Neither payload hashes nor splits of texts stand in a lambda, where they would be computed for each element."""
    lambdas = lambda df: re.findall(r"lambdafunction\(.*", df._jdf.queryExecution().optimizedPlan().toString())
    plan = spark.range(1).select(warc.base32_sha1(F.col("id").cast("string").cast("binary")).alias("d"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sha1(") == 1 and text.index("sha1(") < text.index("lambdafunction(")
    docs = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    pieces = spark.createDataFrame([(b"x", 0, 0, 0, 2)], "row binary, offset long, pass long, start long, words long")
    text = mixing.mixed_texts(docs, pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all(") == 1 and lambdas(plan)


def test_warc_round_trip(spark):
    long = "<p>été</p>" * 30_000
    rows = [(1, "http://a/", "x", ""), (2, None, "x", ""), (3, "http://b/\r\nX: y", None, ""), (4, "u", "", ""), (5, "u", long, ""), (6, "u", long, ""), (7, "u", "WARC/1.1\r\n\r\n\r\n", ""), (8, "u", "﻿\0\r\n" * 5000, "")]
    found = {r["page_id"]: r for r in warc.round_trip(_pages(spark, rows), shared_dir(spark, "warc")).collect()}
    best = {}
    for p, _, html, _ in rows:
        best[html or ""] = max(p, best.get(html or "", p))
    assert set(found) == {r[0] for r in rows}
    for p, _, html, _ in rows:
        r, last = found[p], best[html or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == brute.payload(html)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last == p else ("revisit", last))
    assert warc.round_trip(_pages(spark, []), shared_dir(spark, "warc")).count() == 0


def test_warc_reassembly_names_faults(spark, tmp_path):
    pages = _pages(spark, [(1, "u", "a" * 300_000, ""), (2, "u", "b" * 300_000, "")])
    path = shared_dir(spark, "warc")
    warc.write_archives(warc.records(warc.label(pages.select("page_id", "url", "html"))), path)
    read = warc.read_records(spark, path)
    assert read.filter("segment = 0").count() == 0 and read.count() == 10
    whole = warc.decode(warc.reassemble(read)).collect()
    assert {(r["page_id"], r["payload_bytes"], r["problem"]) for r in whole} == {(1, 300_000, None), (2, 300_000, None)}
    lost = warc.reassemble(read.filter(F.col("segment") != 3))
    assert all(r["problem"] for r in lost.collect())


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_mixing(which, request):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in rows}
    by_source = {}
    for r in rows:
        by_source[r["source"]] = by_source.get(r["source"], 0) + size[r["doc_id"]]
    want = brute.targets(by_source) if rows else {}
    source = {r["doc_id"]: r["source"] for r in rows}
    mixed, pieces = mixing.mix(docs)
    found = mixed.collect()
    assert sorted(r["doc_id"] for r in found) == sorted(size)
    taken = dict.fromkeys(by_source, 0)
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by_source[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in by_source:
        assert abs(taken[s] - want[s]) <= 64 + 0.02 * want[s], (s, taken[s], want[s])
    assert sorted(map(tuple, mixing.mix(docs)[0].collect())) == sorted(map(tuple, found))
    counted = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    assert all(counted.get(r["doc_id"], 0) == r["taken"] for r in found)


def test_mixing_broadcasts_no_side_of_exploded_rows(spark, monkeypatch):
    """A few long documents and runs of slots become very many blocks, which Spark's estimates don't show."""
    frames = {}
    monkeypatch.setattr(mixing, "written", lambda df, name: frames.setdefault(name, df) and written(df, name))
    docs = spark.createDataFrame([(i, "w " * 50_000, f"s{i % 2}") for i in range(6)], "doc_id long, text string, source string")
    mixed, pieces = mixing.mix(docs)
    frames |= {"texts": mixing.mixed_texts(docs, pieces), "documents": mixed.drop("source_size", "target")}
    for name in ("pieces", "texts", "documents"):
        assert frames[name].count()
        frames[name].collect()
        joins = re.findall(r"\w*Join\w*", frames[name]._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0])
        assert "SortMergeJoin" in joins[:2], (name, joins)  # above it at most the few sources


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_near_duplicates(which, request):
    docs = request.getfixturevalue(which)
    want = brute.near_duplicates({r["doc_id"]: r["text"] for r in docs.collect()})
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert found == want


def test_near_duplicates_small_nodes(documents):
    """Tiny nodes, so that trees branch and crowded leaves are compared in blocks."""
    want = brute.near_duplicates({r["doc_id"]: r["text"] for r in documents.collect()})
    found = neardup.near_duplicates(documents, node_size=4, depth=2, trees=12, block_rows=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == want


def test_near_duplicates_repeated_rows(odd):
    twice = neardup.near_duplicates(odd.unionByName(odd)).collect()
    assert len(twice) == 2 * odd.count()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


def _knn(rows, every=50, k=5):
    fine = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in fine if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_knn(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(2000, None), (2050, [float("nan")] * 8), (2100, [None] + [1.0] * 7), (2150, [0.0] * 8), (2200, [1.0, 2.0]), (2201, [3.0, 1.0]), (2250, [])]
    kinds = "vec_id long, embedding array<float>, code string, dim int, n int"
    df = spark.createDataFrame([(*r, "clash", 0, 0) for r in rows], kinds)
    found = sorted(map(tuple, knn.top_k(df).collect()))
    assert found == sorted(_knn(rows))
    assert sorted(map(tuple, knn.top_k(df, block_rows=64, pivots=5).collect())) == found
    assert sorted(map(tuple, knn.top_k(df, block_rows=7, query_rows=2, most_pivots=40, most_groups=3).collect())) == found
    assert knn.top_k(spark.createDataFrame([], kinds)).count() == 0


def test_knn_of_clusters(spark):
    """Far clusters: each query reaches few blocks, and the rows are still those of brute force."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 6)) * 40
    rows = [(i, (middles[i % 12] + rng.normal(size=6)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for limits in ({}, {"block_rows": 20, "query_rows": 3, "groups": 4}):
        assert sorted(map(tuple, knn.top_k(df, every=10, **limits).collect())) == sorted(_knn(rows, every=10))
    parts = knn.Blocks(np.array([4, 1, 7]), np.array([10, 95, 10]), np.zeros(3), np.full(3, 2.0), 40, 7, 3)
    assert parts.parts == 3 and parts.of_cell == {4: (0, 1), 1: (1, 3), 7: (4, 1)}
    away = np.zeros((2, 8))
    away[1, [4, 7]] = 9.0
    assert [list(map(int, x)) for x in parts.reached(away, np.array([1.0, 1.0]))] == [[0, 0, 0, 0, 0, 1, 1, 1], [0, 1, 2, 3, 4, 1, 2, 3]]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf).select(*columns).collect()
    order = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert order(got) == order(want.fetchall())


@pytest.mark.parametrize("percent", [50, 70, 75, 80, 85, 95])
def test_sketches_keep_pairs_at_the_threshold(percent):
    from math import comb

    p, most = 0.75 * (1 - percent / 100), neardup.most_different(percent)
    assert sum(comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(most + 1, 129)) < 1e-4
    assert percent != 85 or most == 31
