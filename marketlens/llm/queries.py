"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (
    ann_graph,
    byte_bpe,
    context_mixing,
    conversation_repair,
    embedding_dedup,
    jaccard_join,
    language_id,
    mixing,
    resampling,
    secret_scan,
    suffix_dedup,
    toxicity,
    url_filters,
)
from marketlens.llm.texts import held_out
from marketlens.plans.registry import query


RANKS = "byte_bpe_multi_50k.tiktoken"


def rank_file(name: str = RANKS) -> bytes:
    import public_tokenizers

    return byte_bpe.load_ranks(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return mixing.taken(planned).select("doc_id", "size", "source_size", "target", "taken")


URL_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fitting AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE place = 1
"""


@query("op4_url_filters", URL_SQL)
def judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query("op6_secret_scan")
def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_scan.digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op8_language_id")
def identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    rows = language_id.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op2_jaccard_join")
def join_by_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.classes(docs).select("doc_id", "n_shingles", "component_id")


@query("op5_byte_bpe")
def encode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, rank_file()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op3_toxicity")
def score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op7_suffix_dedup")
def remove_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_graph.search(rows, rows.where(F.pmod(F.col("vec_id"), F.lit(20)) == 0))


@query("op10_embedding_dedup")
def near_duplicate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.classes(rows).select("vec_id", "n_links", "component_id", "kept")


#: CRC-32 of a text column `w` in plain SQL: the table of the 256 bytes by its rule, then one step a byte.
CRC_TABLE_SQL = """(SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"""
CRC_SQL = """xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: CAST(('0x' || hex(encode(w)[i + 1:i + 1])) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RESAMPLING_SQL = f"""
WITH crc_table AS MATERIALIZED {CRC_TABLE_SQL},
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
wanted AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
words AS MATERIALIZED (SELECT r, unnest(ws) AS w FROM texts),
vocabulary AS MATERIALIZED (
  SELECT w, {CRC_SQL} % 10000 AS bucket FROM (SELECT w FROM words UNION SELECT w FROM wanted), crc_table),
features AS MATERIALIZED (SELECT r, bucket FROM words JOIN vocabulary USING (w)),
s AS (SELECT bucket, count(*) AS s FROM features GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN vocabulary USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gains AS MATERIALIZED (
  SELECT b.range AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range CROSS JOIN totals),
weights AS (SELECT r, sum(gain) AS weight FROM features JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (r)),
ranked AS (
  SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, s.score,
  CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""


@query("op12_importance_resampling", RESAMPLING_SQL)
def resample_towards_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


REPAIR_SQL = f"""
WITH RECURSIVE crc_table AS MATERIALIZED {CRC_TABLE_SQL},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS w FROM conversations),
hits AS MATERIALIZED (SELECT conv_id, turn, role, text, {CRC_SQL} % 20 AS hit FROM given, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hits WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM hurt),
faults AS MATERIALIZED (
  SELECT conv_id, turn, role, text, j, substr(role, 1, 1) AS i,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'd'
      WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY j) || substr(role, 1, 1) AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(j) AS n
  FROM faults GROUP BY conv_id),
best(conv_id, j, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}} FROM counts
  UNION ALL
  SELECT conv_id, j,
    least(b0, {{'c': 3 + least(b2, {{'c': 3 + b3.c, 'a': 'I' || b3.a}}).c, 'a': 'I' || least(b2, {{'c': 3 + b3.c, 'a': 'I' || b3.a}}).a}}),
    least(b1, {{'c': 3 + least(b2, {{'c': 3 + b3.c, 'a': 'I' || b3.a}}).c, 'a': 'I' || least(b2, {{'c': 3 + b3.c, 'a': 'I' || b3.a}}).a}}),
    least(b2, {{'c': 3 + b3.c, 'a': 'I' || b3.a}}), least(b3, {{'c': 3 + b2.c, 'a': 'I' || b2.a}})
  FROM (
    SELECT f.conv_id, f.j,
      least({{'c': 4 + v0.c, 'a': 'D' || v0.a}}, {{'c': free + CASE i WHEN 's' THEN v1.c WHEN 'u' THEN v2.c ELSE 999999 END, 'a': 'K' || CASE i WHEN 's' THEN v1.a ELSE v2.a END}}, {{'c': free + 3 + v2.c, 'a': 'R' || v2.a}}) AS b0,
      least({{'c': 4 + v1.c, 'a': 'D' || v1.a}}, {{'c': free + CASE i WHEN 'u' THEN v2.c ELSE 999999 END, 'a': 'K' || v2.a}}, {{'c': free + 3 + v2.c, 'a': 'R' || v2.a}}) AS b1,
      least({{'c': 4 + v2.c, 'a': 'D' || v2.a}}, {{'c': free + CASE i WHEN 'a' THEN v3.c ELSE 999999 END, 'a': 'K' || v3.a}}, {{'c': free + 3 + v3.c, 'a': 'R' || v3.a}}) AS b2,
      least({{'c': 4 + v3.c, 'a': 'D' || v3.a}}, {{'c': free + CASE i WHEN 'u' THEN v2.c ELSE 999999 END, 'a': 'K' || v2.a}}, {{'c': free + 3 + v2.c, 'a': 'R' || v2.a}}) AS b3
    FROM best JOIN (SELECT *, CASE fault WHEN 't' THEN 3 WHEN '-' THEN 0 ELSE 999999 END AS free FROM faults) f
      ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.j = best.j - 1)),
audits AS MATERIALIZED (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM best WHERE j = 1),
walk(conv_id, audit, k, j, s, made) AS (
  SELECT conv_id, audit, 0, 0, 0, CAST(NULL AS VARCHAR) FROM audits
  UNION ALL
  SELECT conv_id, audit, k + 1, j, t,
    CASE WHEN edit = 'D' THEN made ELSE concat_ws(chr(10), made, CASE WHEN edit = 'K' THEN role WHEN t = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END) END
  FROM (
    SELECT w.*, f.role, f.text, CASE WHEN edit = 'D' THEN s WHEN edit = 'K' AND f.i = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END AS t
    FROM (SELECT conv_id, audit, k, made, s, substr(audit, k + 1, 1) AS edit, j + CASE WHEN substr(audit, k + 1, 1) = 'I' THEN 0 ELSE 1 END AS j FROM walk WHERE k < length(audit)) w
    JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.j = greatest(w.j, 1))),
texts AS (SELECT conv_id, made FROM walk WHERE k = length(audit))
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op13_conversation_repair", REPAIR_SQL)
def repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


@query("op11_lm_scoring")
def score_by_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_mixing.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
