"""The derived views in SQL, as WITH clauses for the checking queries."""

TRADES = """
li AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice AS p, l_quantity AS q,
  row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
    ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_partkey) AS rn,
  count(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS n FROM lineitem),
trades AS (SELECT symbol, trade_date, max(p) FILTER (rn = 1) AS open, max(p) AS high, min(p) AS low,
  max(p) FILTER (rn = n) AS "close", CAST(sum(q) AS BIGINT) AS volume FROM li GROUP BY symbol, trade_date)"""

EVENT_BARS = """
ev AS (SELECT event_type || '_' || (user_id % 5) AS symbol, CAST(ts AS DATE) AS trade_date, event_id, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
event_bars AS (SELECT symbol, trade_date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS "close", CAST(sum(k) AS BIGINT) AS volume FROM ev GROUP BY symbol, trade_date)"""


def hash_bucket(key: str, buckets: int) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {buckets}"


NOISY = f"""
noisy AS (SELECT *, {hash_bucket("symbol || '|' || CAST(trade_date AS VARCHAR)", 20)} AS noise FROM trades)"""

NEWS = """
news AS (SELECT 'SYM' || (d.doc_id % 5) AS feed_symbol, d.doc_id AS feed_pos,
  d.source || ' ' || d.lang || ' ' || (d.doc_id % 50) AS title, d.text AS summary,
  CAST(l.quality - l.toxic AS DOUBLE) AS overall_sentiment_score,
  CASE WHEN l.quality - l.toxic > 0 THEN 'Bullish' WHEN l.quality - l.toxic <= 0 THEN 'Bearish' END
    AS overall_sentiment_label,
  d.source AS source, strftime(TIMESTAMP '2024-01-01' + to_minutes(d.doc_id), '%Y%m%dT%H%M%S') AS time_published,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(d.doc_id), '%Y-%m-%d %H:%M:%S') AS published_at
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

FILINGS = """
od AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey // 1000 ORDER BY o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_custkey, o_orderkey // 1000) AS n FROM orders),
filings AS (SELECT 'C' || o_custkey AS company_name, CAST(o_custkey AS VARCHAR) AS cik, o_orderpriority AS form_type,
  strftime(o_orderdate, '%Y-%m-%d') AS filing_date, 'doc' || o_orderkey || '.htm' AS link_1,
  'ex' || o_orderstatus || '.htm' AS link_2, o_orderstatus AS description, o_orderkey
  FROM od WHERE o_custkey % 7 <> 0 OR rn < n)"""

QUESTIONS = """
questions AS (SELECT o_orderkey AS qid,
  list_extract(['What was the', 'Predict the', 'Explain the', 'What is the next predicted'], (o_orderkey % 4) + 1) || ' ' ||
  list_extract(['closing price', 'Volume', 'highest price', 'lowest price', 'opening price', 'outlook'],
    (o_orderkey % 6) + 1) || ' of ' ||
  list_extract(['Microsoft', 'APPLE', 'netflix', 'Nvidia', 'Amazon', 'nobody'], (o_custkey % 6) + 1) || ' ' ||
  list_extract(['over the last 5 days', 'for 3 days', 'over 11 days', 'tomorrow', 'soon'], (o_custkey % 5) + 1) || '?'
  AS text FROM orders),
asked AS (SELECT qid, text,
  CASE WHEN contains(lower(text), 'microsoft') THEN 'S1' WHEN contains(lower(text), 'apple') THEN 'S2'
    WHEN contains(lower(text), 'netflix') THEN 'S3' WHEN contains(lower(text), 'nvidia') THEN 'S4'
    WHEN contains(lower(text), 'amazon') THEN 'S5' END AS symbol,
  CASE WHEN contains(lower(text), 'closing price') THEN 'close' WHEN contains(lower(text), 'volume') THEN 'volume'
    WHEN contains(lower(text), 'highest price') THEN 'high' WHEN contains(lower(text), 'lowest price') THEN 'low'
    WHEN contains(lower(text), 'opening price') THEN 'open' END AS field,
  CASE WHEN contains(lower(text), '1 day') OR contains(lower(text), 'tomorrow') THEN 1
    WHEN contains(lower(text), '3 days') THEN 3 ELSE 5 END AS days FROM questions),
routed AS (SELECT *, CASE WHEN contains(lower(text), 'predict') AND symbol IS NOT NULL THEN 'prediction'
  WHEN symbol IS NOT NULL AND field IS NOT NULL THEN 'history' ELSE 'free_text' END AS route FROM asked)"""

PREDICTIONS = """
predictions AS (SELECT symbol, trade_date, round(volume * 1.01::DOUBLE, 4) AS volume_prediction,
  round("close" * 1.02::DOUBLE, 4) AS close_prediction, 'seq_a' AS model FROM trades
  UNION ALL SELECT symbol, trade_date, round(volume * 0.99::DOUBLE, 4), round("close" * 0.98::DOUBLE, 4), 'seq_b' FROM trades)"""

PAGES = """
pages_text AS (SELECT conv_id AS doc, turn AS page_no, CASE WHEN turn % 5 = 4 OR text IS NULL OR text = ''
  THEN '[Unable to extract text from this page]' ELSE text END AS text FROM conversations),
assembled AS (SELECT doc, string_agg(text, '' ORDER BY page_no) AS text FROM pages_text GROUP BY doc)"""

CHUNKS = """
chunks AS (SELECT doc || '_chunk_' || i AS chunk_id, doc, i AS chunk_no, substr(text, i * 600 + 1, 1000) AS text
  FROM (SELECT doc, text, unnest(range(0, CAST(ceil(length(text) / 600.0) AS BIGINT))) AS i FROM source_text))"""

NEAREST = """
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings c),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
  QUALIFY rank <= 5)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"
