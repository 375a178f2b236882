"""The queries of the corpus operators over their whole tables, and the SQL that they must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prepweave.llm import fertility, knn, language, lexicon_bpe, mixing, neardup, pii, prefix_trie, resample, secrets, site_quality, toxicity, warc
from prepweave.llm.common import shared_dir, written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    return public_tokenizers.path(name)


#: The rank file's splitting pattern, a fixed value that comes with it.
RANKS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model"), RANKS_PATTERN
    return fertility.judge(_read(spark, sf_dir, "documents"), files, lang="lang")


def op2_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names a document's host by its source and has no path, for which lang stands."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return site_quality.classify(docs, site_quality.learn(docs, _read(spark, sf_dir, "labels")))


def op4_segmented_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages, shared_dir(spark, "warc"))


def op5_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, secrets.train(secrets.labelled_samples(docs))))


#: Base32 from the hexadecimal digest: each five digits are four characters.
OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY payload_digest) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER (PARTITION BY payload_digest) THEN max(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
FROM d
"""


def op7_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_read(spark, sf_dir, "embeddings"))


def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.learn(docs))


def op10_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary("word_bpe_49k.json")
    return lexicon_bpe.code(docs, path, lexicon_bpe.compile_lexicon(spark, lexicon_bpe.count_words(docs, path), path))

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_convolution_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.score(docs, toxicity.learn(docs, _read(spark, sf_dir, "labels")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = written(prefix_trie.strings(_read(spark, sf_dir, "conversations")), "convs")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(convs))


#: crc32 in SQL: the table of 256 remainders, and the fold over a list of bytes.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t"
CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295), 4294967295)"

OP12 = f"""
WITH z AS ({CRC_TABLE}),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT conv_id, turn, substr(sha256(length(r) || ':' || r || x), 1, 32) AS e, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t),
o AS (SELECT conv_id, list(e ORDER BY turn NULLS FIRST, e) AS s FROM e GROUP BY 1),
h AS (SELECT conv_id, s, {CRC.format(bytes="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))")} % 4 AS h FROM o, z),
b AS (SELECT h.conv_id, list_concat(coalesce(p.s[:h], []), h.s[h + 1:]) AS s FROM h LEFT JOIN o p ON p.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, s[:d] AS k, d, len(s) = d AS whole FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM b)),
n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends
  FROM m GROUP BY 1, 2
),
c AS (SELECT k[:d - 1] AS k, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(children, 0) AS children, (n - 1) * coalesce(w, 0) AS saved FROM n LEFT JOIN c USING (k) LEFT JOIN (SELECT DISTINCT e, w FROM e) l ON l.e = n.k[d]),
u AS (SELECT k[:a] AS k, sum(saved) AS saved, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.children AS BIGINT) AS n_children,
  CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u USING (k) LEFT JOIN n p ON f.d > 0 AND p.k = f.k[:f.d - 1]
"""


def op13_ngram_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").select("text"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BYTES = "list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(1 + 2 * i AS INT), 2) AS BIGINT))"
OP13 = f"""
WITH z AS ({CRC_TABLE}),
words AS (
  SELECT doc_id, true AS doc, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT NULL, false, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
),
runs AS (
  SELECT doc_id, doc, unnest(list_concat(w, list_transform(w[2:], lambda x, i: w[i] || ' ' || x), list_transform(w[3:], lambda x, i: w[i] || ' ' || w[i + 1] || ' ' || x))) AS f FROM words
),
counted AS (SELECT doc_id, doc, f, count(*) AS n FROM runs GROUP BY ALL),
names AS (SELECT f, {CRC.format(bytes=_BYTES)} % 10000 AS b FROM (SELECT DISTINCT f FROM counted), z),
bucketed AS (SELECT doc_id, doc, b, sum(n) AS n FROM counted JOIN names USING (f) GROUP BY ALL),
sums AS (SELECT b, sum(n) FILTER (WHERE doc) AS s, sum(n) FILTER (WHERE NOT doc) AS t FROM bucketed GROUP BY 1),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)))) AS gain FROM sums
),
weighed AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM bucketed JOIN gain USING (b) WHERE doc GROUP BY 1),
scored AS (
  SELECT d.doc_id, len(w) AS words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score
  FROM words d LEFT JOIN weighed USING (doc_id) WHERE d.doc
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS docs FROM scored WHERE words >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r <= docs * 5 // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_tokeniser_fertility, op2_information_pii, op3_site_quality, op4_segmented_warc, op5_block_mixing, op6_markov_secrets, op7_chosen_path_near_duplicates, op8_voronoi_knn, op9_rank_order_language, op10_lexicon_bpe, op11_convolution_toxicity, op12_prefix_trie, op13_ngram_importance)}


def oracle_sql() -> dict[str, str]:
    return {"op4_segmented_warc": OP4, "op8_voronoi_knn": OP8, "op12_prefix_trie": OP12, "op13_ngram_importance": OP13}
