import pytest
from pyspark.sql import functions as F

from marketlens.operators import news as N
from marketlens.operators import retrieval
from marketlens.plans import jobs

FEED = ("feed_symbol string, feed_pos int, title string, summary string, overall_sentiment_score double, "
        "overall_sentiment_label string, source string, time_published string")


def feed(spark):
    return spark.createDataFrame([
        ("A", 0, "t1", "good news, very good", 0.5, "Bullish", "s", "20240101T000000"),
        ("A", 1, "t1", "good news, very good", 0.9, "Bullish", "s", "20240101T000000"),
        ("B", 0, "t1", "good news, very good", 0.5, "Bullish", "s", "20240101T000000"),
        ("A", 2, "t2", "not bad", None, None, "s", "20240102T0000"),
        ("A", 3, None, None, None, None, None, "20240103T101112"),
    ], FEED)


@pytest.mark.parametrize("inline_limit", [1000, 3])
def test_polarity(spark, inline_limit):
    texts = ["good", "very good", "not good", "bad and good", "nothing", "", None, "GOOD, good!", "good not", "best extremely best"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, summary string")
    scored = N.lexicon_polarity(df, N.lexicon_frame(spark), inline_limit=inline_limit)
    found = [round(r["custom_sentiment_score"], 4) for r in scored.orderBy("id").collect()]
    assert found == [0.7, 0.91, -0.35, 0.0, 0.0, 0.0, 0.0, 0.7, 0.7, 1.0]
    labels = [r["custom_sentiment_label"] for r in N.label_sentiment(scored).orderBy("id").collect()]
    assert labels[:4] == ["Positive", "Positive", "Negative", "Neutral"]


@pytest.mark.parametrize("inline_limit", [1000, 1])
def test_polarity_of_repeated_words_and_texts(spark, inline_limit):
    entries = [("up", 0.5, 1.0), ("up", -0.25, 1.0), ("so", 0.0, 2.0), ("so", 0.0, 4.0), ("so", 0.25, 1.0), ("flat", 0.5, 1.0), ("flat", -0.5, 1.0)]
    df = spark.createDataFrame([(1, "up"), (1, "so up"), (1, "flat"), (2, None), (2, "up"), (2, "so so")], "id int, summary string")
    scored = N.lexicon_polarity(df, N.lexicon_frame(spark, entries), inline_limit=inline_limit)
    found = sorted((r["id"], r["summary"] or "", round(r["custom_sentiment_score"], 4)) for r in scored.collect())
    assert found == [(1, "flat", 0.0), (1, "so up", 0.3125), (1, "up", 0.125), (2, "", 0.0), (2, "so so", 0.5), (2, "up", 0.125)]


def test_feed_to_table(spark):
    rows = jobs.news_from_feed(feed(spark), N.lexicon_frame(spark)).orderBy("published_at").collect()
    # The repeat in feed A goes, the same article of feed B equals the first, and the time without seconds is set aside.
    assert [(r["headline"], r["original_sentiment_score"], r["custom_sentiment_label"]) for r in rows] == [
        ("t1", 0.5, "Positive"), ("", 0.0, "Neutral")]
    assert [(r["headline"], r["published_at"]) for r in jobs.rejected_news(feed(spark)).collect()] == [("t2", "20240102T0000")]
    shaped = N.project_news(feed(spark))
    _, bad = N.split_unpublished(shaped)
    assert [r["headline"] for r in bad.collect()] == ["t2"]
    assert shaped.where("headline = 't2'").first()["original_sentiment_label"] == "Unknown"


def test_keep_first_follows_feed_order(spark):
    shaped = N.project_news(feed(spark), extra=["feed_pos"]).repartition(4)
    first = N.dedup_news_first(shaped).where("headline = 't1'").collect()
    assert [r["feed_pos"] for r in first] == [0]


def scored(spark, rows=12):
    return spark.range(rows).select(
        F.concat(F.lit("Head "), F.col("id")).alias("headline"), F.concat(F.lit("About Apple "), F.col("id")).alias("summary"),
        (F.col("id") / 8).alias("custom_sentiment_score"), F.lit("Positive").alias("custom_sentiment_label"),
        F.timestamp_seconds(F.col("id")).alias("published_at"),
    )


def test_search_and_card(spark):
    found = N.news_search(scored(spark), "APPLE 1")
    assert [r["headline"] for r in found.collect()] == ["Head 11", "Head 10", "Head 1"]
    card = N.article_card(scored(spark), 1).first()
    assert card["headline"] == "Head 10" and card["score_text"] == "1.25" and card["published_text"] == "1970-01-01 00:00:10"
    assert card["card"].splitlines()[0] == "Headline: Head 10"
    assert N.article_card(scored(spark), 99).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 250])
def test_prompts_list_every_article(spark, rows):
    prompts = retrieval.news_prompts(scored(spark, rows), "What?", "Apple", per_prompt=50).collect()
    assert sum(p["n_articles"] for p in prompts) == rows
    assert sum(p["prompt"].count('"headline"') for p in prompts) == rows
