"""Registered queries over the news feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions import values as V
from marketlens.operators import news as N
from marketlens.operators import retrieval, similar
from marketlens.plans import jobs, views
from marketlens.plans import sql_views as Q
from marketlens.plans.registry import query
from marketlens.sources import landing, sinks
from marketlens.sources.scratch import new_path
from marketlens.streaming import ingest

NEWS = Q.with_views(Q.NEWS)
KEYWORD = "ther"

_SHAPED = """
shaped AS (SELECT feed_symbol, feed_pos, title AS headline, summary, coalesce(overall_sentiment_score, 0) AS original_sentiment_score,
  coalesce(overall_sentiment_label, 'Unknown') AS original_sentiment_label, source, time_published, published_at FROM news)"""
SHAPED = Q.with_views(Q.NEWS, _SHAPED)

_LEXICON = "lexicon(word, polarity, intensity) AS (VALUES " + ", ".join(
    f"('{w}', {p}::DOUBLE, {i}::DOUBLE)" for w, p, i in views.TEST_LEXICON
) + ")"
_POLARITY = """
words AS (SELECT feed_pos, list_filter(regexp_split_to_array(lower(summary), '[^\\p{L}'']+'), lambda w: w <> '') AS ws FROM news),
spoken AS (SELECT feed_pos, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, ws FROM words),
hits AS (SELECT s.feed_pos, greatest(-1, least(1, r.polarity * coalesce(m.intensity, 1))) AS value
  FROM spoken s JOIN lexicon r ON s.word = r.word AND r.polarity <> 0
  LEFT JOIN lexicon m ON s.i > 1 AND s.ws[s.i - 1] = m.word AND m.polarity = 0),
polarity AS (SELECT n.feed_pos, coalesce(h.score, 0) AS score FROM news n
  LEFT JOIN (SELECT feed_pos, avg(value) AS score FROM hits GROUP BY feed_pos) h USING (feed_pos))"""
POLARITY = Q.with_views(Q.NEWS, _SHAPED, _LEXICON, _POLARITY)


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.project_news(views.news(spark, sf_dir), extra=["feed_symbol", "feed_pos"])


def _lexicon(spark: SparkSession) -> DataFrame:
    return N.lexicon_frame(spark, views.TEST_LEXICON)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed in table shape, with a score from the feed's own label and the publication time parsed."""
    shaped = N.parse_published(_shaped(spark, sf_dir))
    return N.label_sentiment(shaped.withColumn("custom_sentiment_score", F.col("original_sentiment_score") / 4))


_SCORED = """
scored AS (SELECT feed_pos, headline, summary, original_sentiment_score / 4 AS custom_sentiment_score,
  CASE WHEN original_sentiment_score > 0 THEN 'Positive' WHEN original_sentiment_score < 0 THEN 'Negative' ELSE 'Neutral' END
    AS custom_sentiment_label, published_at FROM shaped)"""
SCORED = Q.with_views(Q.NEWS, _SHAPED, _SCORED)


def _write_feed(feed: DataFrame, path: str) -> None:
    """Feed files per symbol; each line is a JSON array of the items of 1,000 feed positions at most."""
    item = F.struct("feed_pos", *S.NEWS_ITEM.names)
    arrays = feed.groupBy("feed_symbol", F.floor(F.col("feed_pos") / 1000).alias("part")).agg(
        F.to_json(F.sort_array(F.collect_list(item))).alias("value")
    )
    sinks.balanced(arrays.select("feed_symbol", "value"), "feed_symbol").write.partitionBy("feed_symbol").text(path)


FEED_SYMBOL = r"feed_symbol=([^/]+)/"


@query("scan_news_json", NEWS + """
SELECT feed_symbol, row_number() OVER (PARTITION BY feed_symbol, feed_pos // 1000 ORDER BY feed_pos) - 1 AS feed_pos,
  title, md5(summary) AS summary_md5, overall_sentiment_score, overall_sentiment_label, source, time_published FROM news""")
def scan_news_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "news")
    _write_feed(views.news(spark, sf_dir), path)
    found = landing.read_news(spark, f"{path}/*", lines=True, name_pattern=FEED_SYMBOL)
    return found.withColumn("summary_md5", F.md5("summary")).drop("summary", "feed_order")


@query("scan_news_variant", NEWS + """
SELECT feed_symbol, title AS headline, md5(summary) AS summary_md5, coalesce(overall_sentiment_score, 0) AS score,
  time_published FROM news""")
def scan_news_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "news")
    _write_feed(views.news(spark, sf_dir), path)
    items = landing.read_news_variant(spark, f"{path}/*", lines=True, name_pattern=FEED_SYMBOL)
    shaped = N.project_variant_news(items, extra=["feed_symbol"])
    return shaped.select(
        "feed_symbol", "headline", F.md5("summary").alias("summary_md5"),
        F.col("original_sentiment_score").alias("score"), F.col("published_at").alias("time_published"),
    )


@query("project_news", SHAPED + """
SELECT feed_symbol, feed_pos, headline, md5(summary) AS summary_md5, original_sentiment_score, original_sentiment_label,
  source, time_published AS published_at FROM shaped""")
def project_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir).withColumn("summary_md5", F.md5("summary")).drop("summary")


@query("default_if_missing", NEWS + """
SELECT feed_pos, title AS headline,
  CASE WHEN overall_sentiment_score IS NULL AND feed_pos % 2 = 0 THEN NULL ELSE coalesce(overall_sentiment_score, 0) END
    AS original_sentiment_score,
  CASE WHEN overall_sentiment_label IS NULL AND feed_pos % 2 = 0 THEN NULL
    ELSE coalesce(overall_sentiment_label, 'Unknown') END AS original_sentiment_label FROM news""")
def default_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = views.news(spark, sf_dir)
    record = F.struct("title", "summary", "overall_sentiment_score", "overall_sentiment_label", "source")
    # Half of the feed writes a JSON null for a missing value, the other half leaves the key out.
    text = F.when(F.col("feed_pos") % 2 == 0, F.to_json(record, {"ignoreNullFields": "false"})).otherwise(F.to_json(record))
    items = feed.select("feed_pos", F.parse_json(text).alias("item"))
    return N.project_variant_news(items, extra=["feed_pos"]).select(
        "feed_pos", "headline", "original_sentiment_score", "original_sentiment_label"
    )


@query("sentiment_label", SCORED + "SELECT feed_pos, custom_sentiment_score, custom_sentiment_label FROM scored")
def sentiment_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("feed_pos", "custom_sentiment_score", "custom_sentiment_label")


@query("parse_published", NEWS + "SELECT feed_pos, time_published, published_at FROM news")
def parse_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.news(spark, sf_dir).select(
        "feed_pos", "time_published", V.to_published(F.col("time_published")).alias("published_at")
    )


@query("split_unpublished", SHAPED + """
SELECT feed_pos, CASE WHEN feed_pos % 3 = 0 THEN NULL ELSE published_at END AS published_at, feed_pos % 3 = 0 AS rejected
FROM shaped""")
def split_unpublished(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every third time lacks its seconds.
    short = F.when(F.col("feed_pos") % 3 == 0, F.substring("published_at", 1, 13)).otherwise(F.col("published_at"))
    good, bad = N.split_unpublished(_shaped(spark, sf_dir).withColumn("published_at", short))
    return good.select("feed_pos", "published_at", F.lit(False).alias("rejected")).unionByName(
        bad.select("feed_pos", F.lit(None).cast("timestamp").alias("published_at"), F.lit(True).alias("rejected"))
    )


@query("lexicon_polarity", POLARITY + "SELECT feed_pos, round(score, 6) AS custom_sentiment_score FROM polarity")
def lexicon_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = N.lexicon_polarity(_shaped(spark, sf_dir), _lexicon(spark))
    return scored.select("feed_pos", F.round("custom_sentiment_score", 6).alias("custom_sentiment_score"))


@query("lexicon_polarity_join", POLARITY + "SELECT feed_pos, round(score, 6) AS custom_sentiment_score FROM polarity")
def lexicon_polarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = N.lexicon_polarity(_shaped(spark, sf_dir), _lexicon(spark), inline_limit=0)
    return scored.select("feed_pos", F.round("custom_sentiment_score", 6).alias("custom_sentiment_score"))


@query("dedup_news_first", SHAPED + """
SELECT feed_pos, headline, md5(summary) AS summary_md5, original_sentiment_score, published_at FROM shaped
QUALIFY row_number() OVER (PARTITION BY headline, summary, source, published_at ORDER BY feed_pos) = 1""")
def dedup_news_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = N.project_news(views.news_twice(spark, sf_dir), extra=["feed_pos"])
    first = N.parse_published(N.dedup_news_first(twice))
    return first.select(
        "feed_pos", "headline", F.md5("summary").alias("summary_md5"), "original_sentiment_score", "published_at"
    )


@query("dedup_full_row", Q.with_views(Q.NEWS) + """
SELECT headline, md5(summary) AS summary_md5, source, count(*) AS n FROM (
  SELECT DISTINCT title AS headline, summary, source, overall_sentiment_score FROM (
    SELECT * FROM news UNION ALL SELECT * REPLACE (CASE WHEN feed_pos % 7 = 0 THEN 0.25 ELSE overall_sentiment_score END
      AS overall_sentiment_score) FROM news))
GROUP BY headline, summary, source""")
def dedup_full_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.news_twice(spark, sf_dir).select(
        F.col("title").alias("headline"), "summary", "source", "overall_sentiment_score"
    )
    distinct = N.dedup_full_row(rows)
    return distinct.groupBy("headline", F.md5("summary").alias("summary_md5"), "source").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("news_search", SCORED + f"""
SELECT headline, md5(summary) AS summary_md5, custom_sentiment_score, custom_sentiment_label, published_at FROM scored
WHERE lower(headline) LIKE '%{KEYWORD}%' OR lower(summary) LIKE '%{KEYWORD}%' ORDER BY published_at DESC""")
def news_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.news_search(_scored(spark, sf_dir), KEYWORD)
    return found.withColumn("summary_md5", F.md5("summary")).drop("summary")


@query("param_query", SCORED + """
SELECT headline, md5(summary) AS summary_md5, published_at FROM scored
WHERE lower(headline) <> 'src3 en 1' AND (contains(lower(summary), 'the') OR contains(lower(headline), 'the'))""")
def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """SELECT headline, md5(summary) AS summary_md5, published_at FROM {news}
        WHERE lower(headline) <> lower(:headline) AND (contains(lower(summary), :words) OR contains(lower(headline), :words))"""
    return landing.param_query(
        spark, sql, {"headline": "SRC3 en 1", "words": "the"}, news=_scored(spark, sf_dir)
    )


@query("article_card", SCORED + """
SELECT headline, published_at AS published_text, summary, printf('%.2f', custom_sentiment_score) AS score_text,
  custom_sentiment_label,
  'Headline: ' || headline || chr(10) || 'Summary: ' || summary || chr(10) || 'Sentiment: ' || custom_sentiment_label AS card
FROM scored ORDER BY published_at DESC, headline, summary LIMIT 1 OFFSET 2""")
def article_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.article_card(_scored(spark, sf_dir), 2)


@query("similar_articles", SCORED + """
, low AS (SELECT feed_pos, lower(headline) AS headline, lower(summary) AS summary, published_at FROM scored),
matches AS (SELECT a.feed_pos AS feed_pos, b.feed_pos AS similar_feed_pos, b.published_at AS published_at
  FROM low a JOIN low b ON a.headline <> b.headline
    AND (contains(b.summary, a.summary) OR contains(b.headline, a.summary))
  WHERE trim(a.summary) <> '')
SELECT *, row_number() OVER (PARTITION BY feed_pos ORDER BY published_at DESC, similar_feed_pos) AS rank FROM matches
QUALIFY rank <= 5""")
def similar_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_articles(_scored(spark, sf_dir), "feed_pos")


@query("similar_to", SCORED + """
SELECT headline, md5(summary) AS summary_md5, published_at FROM scored
WHERE lower(headline) <> 'src3 en 1' AND contains(lower(summary), 'that')
ORDER BY published_at DESC, headline, summary LIMIT 5""")
def similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar.similar_to(_scored(spark, sf_dir), "SRC3 en 1", "That")
    return found.select("headline", F.md5("summary").alias("summary_md5"), "published_at")


@query("news_prompts", SCORED + f"""
SELECT count(DISTINCT (headline, summary, published_at)) AS articles, true AS all_listed FROM scored
WHERE contains(lower(headline), '{KEYWORD}') OR contains(lower(summary), '{KEYWORD}')""")
def news_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.news_search(_scored(spark, sf_dir), KEYWORD)
    prompts = retrieval.news_prompts(found, "What happened?", KEYWORD)
    listed = F.size(F.regexp_extract_all("prompt", F.lit('"published_at":'), F.lit(0)))
    return prompts.agg(
        F.sum("n_articles").alias("articles"), F.min(listed >= F.col("n_articles")).alias("all_listed")
    )


_NEWS_TABLE = POLARITY + """
SELECT headline, md5(summary) AS summary_md5, original_sentiment_score, original_sentiment_label,
  round(score, 6) AS custom_sentiment_score,
  CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS custom_sentiment_label,
  source, published_at FROM shaped JOIN polarity USING (feed_pos)"""


def _table_shown(typed: DataFrame) -> DataFrame:
    return typed.withColumns({
        "summary_md5": F.md5("summary"), "custom_sentiment_score": F.round("custom_sentiment_score", 6),
    }).drop("summary")


@query("news_table", _NEWS_TABLE)
def news_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_shown(jobs.news_from_feed(views.news_twice(spark, sf_dir), _lexicon(spark)))


@query("stream_dedup_news", NEWS + """
SELECT DISTINCT title AS headline, md5(summary) AS summary_md5, source, published_at FROM news""")
def stream_dedup_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed, out, rejected, checkpoint = (new_path(spark, n) for n in ("feed", "news", "rejected", "progress"))
    feed = views.news_twice(spark, sf_dir).drop("feed_symbol", "feed_pos")
    moment = V.to_published(F.col("time_published")).cast("long")
    middle = feed.agg(F.percentile_approx(moment, 0.5)).first()[0]
    # The first run lands the newer half; the second lands the older half and the newer one again.
    for landing_now in (feed.where(moment >= middle), feed):
        landing_now.write.mode("append").json(landed, compression="gzip")
        ingest.run_news(ingest.stream_news(spark, landed), out, rejected, checkpoint)
    found = spark.read.schema(ingest.STORED_NEWS).parquet(out)
    return found.select("headline", F.md5("summary").alias("summary_md5"), "source", "published_at")


@query("stream_news_table", _NEWS_TABLE)
def stream_news_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed, out, rejected, checkpoint = (new_path(spark, n) for n in ("feed", "news", "rejected", "progress"))
    feed = views.news(spark, sf_dir).drop("feed_symbol", "feed_pos")
    for _ in range(2):  # the same items land twice
        feed.write.mode("append").json(landed, compression="gzip")
        ingest.run_news(ingest.stream_news(spark, landed), out, rejected, checkpoint, _lexicon(spark))
    return _table_shown(spark.read.schema(ingest.STORED_NEWS).parquet(out).select(*S.NEWS_SENTIMENT.names))


@query("news_from_files", POLARITY + """
SELECT title AS headline, md5(summary) AS summary_md5,
  CASE WHEN feed_pos % 2 = 0 THEN overall_sentiment_score ELSE coalesce(overall_sentiment_score, 0) END AS original_sentiment_score,
  CASE WHEN feed_pos % 2 = 0 THEN overall_sentiment_label ELSE coalesce(overall_sentiment_label, 'Unknown') END
    AS original_sentiment_label,
  round(score, 6) AS custom_sentiment_score,
  CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS custom_sentiment_label,
  source, published_at FROM news JOIN polarity USING (feed_pos)""")
def news_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Files in two folders hold the feed twice, the later copy with some other scores; every other item writes its nulls out.
    path = new_path(spark, "news")
    twice = views.news_twice(spark, sf_dir)
    for part, copy in enumerate((twice.where("feed_pos < 1000000000"), twice.where("feed_pos >= 1000000000"))):
        item = F.struct(*S.NEWS_ITEM.names)
        text = F.when(F.col("feed_pos") % 2 == 0, F.to_json(item, {"ignoreNullFields": "false"})).otherwise(F.to_json(item))
        lines = copy.select("feed_symbol", text.alias("value"))
        sinks.balanced(lines, "feed_symbol").write.partitionBy("feed_symbol").text(f"{path}/part={part}")
    feed = landing.read_news_variant(spark, f"{path}/*/*", lines=True, name_pattern=FEED_SYMBOL)
    return _table_shown(jobs.news_from_feed(feed, _lexicon(spark)))


@query("rejected_news", SHAPED + """
SELECT headline, md5(summary) AS summary_md5, source, substr(time_published, 1, 13) AS published_at FROM shaped WHERE feed_pos % 3 = 0""")
def rejected_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every third time lacks its seconds.
    short = F.when(F.col("feed_pos") % 3 == 0, F.substring("time_published", 1, 13)).otherwise(F.col("time_published"))
    rejected = jobs.rejected_news(views.news(spark, sf_dir).withColumn("time_published", short))
    return rejected.select("headline", F.md5("summary").alias("summary_md5"), "source", "published_at")
