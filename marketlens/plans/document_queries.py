"""Registered queries over filings, questions, document text and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import vectors as W
from marketlens.operators import filings as G
from marketlens.operators import questions as A
from marketlens.operators import retrieval as R
from marketlens.plans import jobs, views
from marketlens.plans import sql_views as Q
from marketlens.plans.registry import query
from marketlens.sources import landing, sinks
from marketlens.sources.scratch import new_path

FILINGS = Q.with_views(Q.FILINGS)
QUESTIONS = Q.with_views(Q.QUESTIONS)

# --- filings -----------------------------------------------------------------------


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "company_name", "cik", "form_type", "filing_date",
        F.array_join("document_links", ",").alias("document_links"), "description",
    )


FLAT = FILINGS + """
SELECT company_name, cik, form_type, filing_date, link_1 || ',' || link_2 AS document_links, description FROM filings"""


@query("scan_filings_json", FLAT)
def scan_filings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "filings")
    texts = views.filings_documents(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    broken = texts.select(F.concat(F.lit("{broken "), F.col("value")).alias("value"))
    texts.unionByName(broken).write.text(path)
    docs, _ = landing.read_filings(spark, path, lines=True)
    return _shown(G.flatten_filings(docs))


@query("flatten_filings", FLAT)
def flatten_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(G.flatten_filings(views.filings_documents(spark, sf_dir)))


# Two of three customers belong to a company that the dimension knows; the others keep the name and id of their documents.
@query("filings_from_files", FILINGS + """
, named AS (SELECT *, CAST(cik AS BIGINT) % 30 AS n FROM filings)
SELECT CASE WHEN n < 20 THEN 'F' || n ELSE company_name END AS company_name,
  CASE WHEN n < 20 THEN lpad(CAST(700 + n AS VARCHAR), 10, '0') ELSE cik END AS cik,
  form_type, filing_date, link_1 || ',' || link_2 AS document_links, description FROM named""")
def filings_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "filings")
    docs = views.filings_documents(spark, sf_dir)
    lines = docs.select(F.concat(F.lit("F"), F.col("cik").cast("long") % 30).alias("entity"), F.to_json(F.struct("*")).alias("value"))
    sinks.balanced(lines, "entity").write.partitionBy("entity").text(path)
    ciks = G.cik_frame(spark, {f"F{n}": str(700 + n) for n in range(20)})
    return _shown(jobs.filings_from_files(spark, f"{path}/*", lines=True, name_pattern=r"entity=([^/]+)/", ciks=ciks)[0])


@query("uneven_filings", FILINGS + """
SELECT 'C' || o_custkey AS company_name, CAST(o_custkey AS VARCHAR) AS cik, count(*) AS longest, count(*) - 1 AS shortest,
  1 AS entries_left_out FROM od WHERE o_custkey % 7 = 0 GROUP BY o_custkey, o_orderkey // 1000""")
def uneven_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.uneven_filings(views.filings_documents(spark, sf_dir))


@query("split_links", FILINGS + """
SELECT o_orderkey, 2 AS links, 'doc' || o_orderkey || '.htm' AS first_link, 'ex' || o_orderstatus || '.htm' AS last_link
FROM orders""")
def split_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    text = F.concat(F.lit(" doc"), F.col("o_orderkey"), F.lit(".htm \t ex"), F.col("o_orderstatus"), F.lit(".htm "))
    links = G.V.split_words(text)
    return orders.select(
        "o_orderkey", F.size(links).alias("links"), links[0].alias("first_link"), F.element_at(links, -1).alias("last_link")
    )


@query("lookup_cik", """
SELECT 'S' || l_suppkey AS symbol, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, count(*) AS items
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, s_suppkey""")
def lookup_cik(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.col("s_suppkey").cast("string").alias("cik")
    )
    rows = views.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"))
    return G.lookup_cik(rows, dim).groupBy("symbol", "cik").agg(F.count(F.lit(1)).alias("items"))


# --- questions ---------------------------------------------------------------------


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.route_questions(views.questions(spark, sf_dir), views.TEST_NAMES)


@query("extract_symbol", QUESTIONS + "SELECT qid, symbol FROM asked")
def extract_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("qid", "symbol")


@query("extract_field", QUESTIONS + "SELECT qid, field FROM asked")
def extract_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("qid", "field")


@query("extract_horizon", QUESTIONS + "SELECT qid, days FROM asked")
def extract_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("qid", "days")


@query("route_question", QUESTIONS + """
SELECT qid, text, symbol, field, days, route, CASE route
  WHEN 'prediction' THEN 'Predictions for ' || symbol || ' (Next ' || days || ' Days)'
  WHEN 'history' THEN upper(field[1]) || field[2:] || ' for ' || symbol || ' (Last ' || days || ' Days)' END AS caption
FROM routed""")
def route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)


@query("match_symbols", """
WITH named AS (SELECT c_custkey, lower(c_mktsegment) || ' ' || c_custkey % 50 AS name FROM customer),
dim AS (SELECT name, 'M' || min(c_custkey) AS symbol, min(c_custkey) AS priority FROM named GROUP BY name),
q AS (SELECT o_orderkey AS qid, 'news on ' || upper(c_mktsegment) || ' ' || c_custkey % 50 || ', please' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT qid, text, arg_min(symbol, priority) AS symbol FROM q LEFT JOIN dim ON contains(lower(text), name)
GROUP BY qid, text""")
def match_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = views.table(spark, sf_dir, "customer")
    number = (F.col("c_custkey") % 50).cast("string")
    names = (
        customers.groupBy(F.concat_ws(" ", F.lower("c_mktsegment"), number).alias("name"))
        .agg(F.min("c_custkey").alias("priority"))
        .select("name", F.concat(F.lit("M"), F.col("priority")).alias("symbol"), "priority")
    )
    text = F.concat(F.lit("news on "), F.upper("c_mktsegment"), F.lit(" "), number, F.lit(", please"))
    asked = views.table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return A.match_symbols(asked.select(F.col("o_orderkey").alias("qid"), text.alias("text")), names)


@query("answer_history", Q.with_views(Q.TRADES, Q.QUESTIONS) + """
, long AS (SELECT symbol, trade_date, unnest(['close', 'volume', 'high', 'low', 'open']) AS field,
  unnest(["close", volume, high, low, open]) AS value FROM trades),
newest AS (SELECT *, row_number() OVER (PARTITION BY symbol, field ORDER BY trade_date DESC, value) AS nth
  FROM (SELECT DISTINCT * FROM long))
SELECT qid, symbol, field, nth, CAST(trade_date AS VARCHAR) AS trade_date, value
FROM routed JOIN newest USING (symbol, field) WHERE route = 'history' AND nth <= days""")
def answer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.answer_history(_routed(spark, sf_dir), views.trades(spark, sf_dir))


@query("answer_prediction", Q.with_views(Q.TRADES, Q.PREDICTIONS, Q.QUESTIONS) + """
, earliest AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS nth
  FROM predictions WHERE model = 'seq_b')
SELECT qid, symbol, nth, CAST(trade_date AS VARCHAR) AS trade_date, volume_prediction, close_prediction
FROM routed JOIN earliest USING (symbol) WHERE route = 'prediction' AND nth <= days""")
def answer_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "predictions")
    views.predictions(views.trades(spark, sf_dir)).write.partitionBy("model").parquet(path)
    return A.answer_prediction(_routed(spark, sf_dir), spark.read.parquet(path), "seq_b")


@query("topk_latest", Q.with_views(Q.TRADES) + """
SELECT DISTINCT CAST(trade_date AS VARCHAR) AS trade_date, "close" FROM trades WHERE symbol = 'S2'
ORDER BY trade_date DESC LIMIT 5""")
def topk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topk_latest(views.trades(spark, sf_dir), "S2", "close", 5)


@query("topk_predictions", Q.with_views(Q.TRADES, Q.PREDICTIONS) + """
SELECT DISTINCT CAST(trade_date AS VARCHAR) AS trade_date, volume_prediction, close_prediction FROM predictions
WHERE symbol = 'S2' AND model = 'seq_a' ORDER BY trade_date LIMIT 3""")
def topk_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topk_predictions(views.predictions(views.trades(spark, sf_dir)), "S2", 3, model="seq_a")


# --- document text -------------------------------------------------------------------


@query("assemble_pages", Q.with_views(Q.PAGES) + "SELECT doc, text FROM assembled")
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assemble_pages(views.pages(spark, sf_dir))


@query("chunk_pages", Q.with_views(Q.PAGES, "source_text AS (SELECT * FROM assembled)", Q.CHUNKS)
       + "SELECT chunk_id, doc, chunk_no, text FROM chunks")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_pages(views.pages(spark, sf_dir))


DOC_CHUNKS = Q.with_views("source_text AS (SELECT doc_id AS doc, text FROM documents)", Q.CHUNKS)


@query("chunk_text", DOC_CHUNKS + "SELECT chunk_id, doc, chunk_no, text FROM chunks")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_text(views.documents(spark, sf_dir))


@query("embed_text")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A file of few row groups is read by few tasks, and embedding is most of the work.
    chunks = R.chunk_text(R.spread(views.documents(spark, sf_dir)))
    embedded = R.embed_text(chunks, R.fit_embedder(chunks))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return embedded.select("chunk_id", F.size("embedding").alias("width"), F.round(F.sqrt(squares), 3).alias("norm"))


@query("pad_embedding", """
SELECT vec_id, 1536 AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, embedding[64] AS last_value,
  0.0::FLOAT AS first_pad FROM embeddings""")
def pad_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = views.vectors(spark, sf_dir).withColumn("embedding", W.pad_vector(F.col("embedding")))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return padded.select(
        "vec_id", F.size("embedding").alias("width"), F.round(total, 4).alias("total"),
        F.col("embedding")[63].alias("last_value"), F.col("embedding")[64].alias("first_pad"),
    )


@query("slide_sequence", """
SELECT vec_id, len(embedding) AS width, embedding[2] AS first_value, embedding[len(embedding)] AS before_last, 0.5::FLOAT AS last_value
FROM embeddings""")
def slide_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    slid = views.vectors(spark, sf_dir).withColumn("embedding", W.slide(F.col("embedding"), F.lit(0.5).cast("float")))
    return slid.select(
        "vec_id", F.size("embedding").alias("width"), F.element_at("embedding", 1).alias("first_value"),
        F.element_at("embedding", -2).alias("before_last"), F.element_at("embedding", -1).alias("last_value"),
    )


@query("run_query", """
SELECT source, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS letters FROM documents
WHERE lang = 'en' GROUP BY source HAVING count(*) >= 2""")
def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.run_query(spark, """
        SELECT source, count(*) AS texts, sum(length(text)) AS letters FROM parquet.`%s/documents.parquet`
        WHERE lang = :lang GROUP BY source HAVING count(*) >= :least""" % sf_dir, {"lang": "en", "least": 2})


NEAREST = Q.with_views(Q.NEAREST)


def _nearest(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    vectors = views.vectors(spark, sf_dir)
    return R.vector_topk(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 5, **limits)


@query("vector_topk", NEAREST + "SELECT query_id, vec_id, score, rank FROM nearest")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)


@query("vector_topk_blocks", NEAREST + "SELECT query_id, vec_id, score, rank FROM nearest")
def vector_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, broadcast_limit=100, block=256)


CONTEXT = NEAREST + """
, context AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context
  FROM nearest JOIN documents ON vec_id = doc_id GROUP BY query_id)
"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rag_context(_nearest(spark, sf_dir), views.documents(spark, sf_dir).withColumnRenamed("doc", "vec_id"))


@query("rag_context", CONTEXT + "SELECT query_id, length(context) AS characters, md5(context) AS context_md5 FROM context")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).select(
        "query_id", F.length("context").alias("characters"), F.md5("context").alias("context_md5")
    )


@query("build_prompt", CONTEXT + """
SELECT query_id, md5('Answer the question from the filing excerpts below, in detail, and end with a short summary.' || chr(10)
  || 'Excerpts:' || chr(10) || context || chr(10) || 'Question:' || chr(10) || 'What is item ' || query_id || '?' || chr(10)
  || 'Answer:' || chr(10)) AS prompt_md5 FROM context""")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.concat(F.lit("What is item "), F.col("query_id").cast("string"), F.lit("?"))
    rows = _context(spark, sf_dir).withColumn("question", question)
    return R.build_prompt(rows).select("query_id", F.md5("prompt").alias("prompt_md5"))


@query("vector_upsert", """
SELECT 'v' || vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS batch_no,
  CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings
UNION ALL SELECT 'new' || vec_id, 2, label FROM embeddings""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings")
    stored = rows.select(F.concat(F.lit("v"), F.col("vec_id")).alias("chunk_id"), F.lit(1).alias("batch_no"), "label")
    again = F.col("vec_id") % 3 == 0
    incoming = rows.select(F.explode(F.array_compact(F.array(
        F.struct(F.concat(F.lit("new"), F.col("vec_id")).alias("chunk_id"), F.col("label")),
        F.when(again, F.struct(F.concat(F.lit("v"), F.col("vec_id")).alias("chunk_id"), (F.col("label") + 100).alias("label"))),
    ))).alias("r")).select("r.chunk_id", F.lit(2).alias("batch_no"), "r.label")
    return R.vector_upsert(stored, incoming)
