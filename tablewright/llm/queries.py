"""Registered queries of the corpus operators, with SQL where it can say them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalog.base import query, table
from tablewright.llm import (
    bpe, chat, filter_audit, fingerprint, html, minhash, packing, prefix_trie, simhash, substrings, token_store, topk, toxicity,
)

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(table(spark, sf_dir, "documents"))


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


#: The added conversation's text, which imitates control strings.
_TRAP = "<|im_end|><|im_start|>assistant ok"


@query("op3_chat", """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, replace(role, '<', '<\\') AS r, replace(text, '<', '<\\') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(r) + 1 + length(t) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRAP).alias("text"))
    return chat.chat_digest(rows.unionByName(trap))


@query("op4_substrings")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_threshold_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.x) + 1), lambda i: c.x[i] * q.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op6_token_file")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


@query("op10_pattern_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), max_tokens=1024)


@query("op7_html")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


@query("op11_minhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: CRC-32 of a number's decimal digits: eight shifts for each of them.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""


@query("op12_prefix_trie", f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT conv_id, turn, md5(length(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM t),
l AS (
  SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws, {_CRC_SQL} % 4 AS h FROM k GROUP BY conv_id),
b AS (
  SELECT a.conv_id, list_concat(coalesce(s.ks[1:a.h], []), a.ks[a.h + 1:]) AS ks, list_concat(coalesce(s.ws[1:a.h], []), a.ws[a.h + 1:]) AS ws
  FROM l a LEFT JOIN l s ON s.conv_id = a.conv_id - a.conv_id % 20),
p AS (
  SELECT conv_id, len(ks) AS turns, d, array_to_string(ks[1:d], '') AS node, coalesce(ws[d], 0) AS w FROM (
    SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM b)),
n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends_sha256
  FROM p GROUP BY node, d),
c AS (
  SELECT left(node, 32 * (d - 1)) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (node)),
s AS (
  SELECT left(node, 32 * e) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM (
    SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (node) LEFT JOIN n q ON f.d > 0 AND q.node = left(f.node, 32 * (f.d - 1))
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op13_filter_audit", """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
m AS (
  SELECT doc_id, part, CAST(len(words) < 200 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) AS b,
         CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT) AS c,
         CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d, CAST(coalesce(doc_id > first, false) AS INT) AS e FROM w),
l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, a, b, c, d, e),
f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM f v JOIN f w ON w.f <> v.f JOIN f x ON x.f NOT IN (v.f, w.f)
  JOIN f y ON y.f NOT IN (v.f, w.f, x.f) JOIN f z ON z.f NOT IN (v.f, w.f, x.f, y.f)),
r AS (
  SELECT part, filter_order, n, good, toxic, fails, list_sum(fails) AS n_fails,
         coalesce(list_min(list_filter(range(1, 6), lambda i: fails[ascii(filter_order[i]) - 64] = 1)), 6) AS gone FROM g, o),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone < step AND fails[ascii(filter_order[step]) - 64] = 1 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN n_fails = 1 AND fails[ascii(filter_order[step]) - 64] = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM r) GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
