"""News feed: shape, sentiment, keep-first, distinct, search and article cards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import values as V
from marketlens.operators.ranked import keep_first, row_digest

# Fixed value: card format.
CARD = "Headline: %s\nSummary: %s\nSentiment: %s"
NEWS_KEY = ["headline", "summary", "source", "published_at"]

# Words of a lexicon that is sent along with the scoring tasks, and its hash buckets.
INLINE_LEXICON = 20000
LEXICON_BUCKETS = 4096

# A small general-purpose lexicon of word, polarity, intensity.
# Rows with polarity 0 change the word after them: they scale it, or negate it
# when the intensity is negative.
LEXICON = [
    ("good", 0.7, 1.0), ("great", 0.8, 1.0), ("gain", 0.4, 1.0), ("growth", 0.4, 1.0),
    ("strong", 0.5, 1.0), ("profit", 0.5, 1.0), ("record", 0.3, 1.0), ("best", 1.0, 1.0),
    ("positive", 0.6, 1.0), ("success", 0.6, 1.0), ("bad", -0.7, 1.0), ("loss", -0.5, 1.0),
    ("weak", -0.4, 1.0), ("poor", -0.4, 1.0), ("decline", -0.4, 1.0), ("risk", -0.2, 1.0),
    ("worst", -1.0, 1.0), ("negative", -0.6, 1.0), ("failure", -0.6, 1.0), ("lawsuit", -0.4, 1.0),
    ("very", 0.0, 1.3), ("extremely", 0.0, 1.5), ("slightly", 0.0, 0.5),
    ("not", 0.0, -0.5), ("never", 0.0, -0.5), ("no", 0.0, -0.5),
]


def lexicon_frame(spark: SparkSession, entries: Sequence[tuple[str, float, float]] = LEXICON) -> DataFrame:
    return spark.createDataFrame(list(entries), "word string, polarity double, intensity double")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}']+"), lambda w: w != "")


def _clip(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def lexicon_polarity(articles: DataFrame, lexicon: DataFrame, text: str = "summary",
                     score: str = "custom_sentiment_score", inline_limit: int = INLINE_LEXICON) -> DataFrame:
    """Mean polarity in [-1, 1] of the lexicon words of a text; 0 where there is none.

    A word that the lexicon repeats counts with the mean of its entries, separately as a rated word and as a
    modifier. A lexicon of up to `inline_limit` words goes along as one value, and texts are scored
    where they are, without a shuffle. A larger one is joined word by word. Both give the same scores.
    """
    entries = _word_entries(lexicon)
    if entries.limit(inline_limit + 1).count() <= inline_limit:
        return _polarity_in_place(articles, entries, text, score)
    return _polarity_by_join(articles, entries, text, score)


def _word_entries(lexicon: DataFrame) -> DataFrame:
    """One row per word: its polarity if it is rated, its intensity if it modifies the word after it."""
    rated = F.col("polarity") != 0
    return lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(
        F.avg(F.when(rated, F.col("polarity"))).alias("polarity"),
        F.avg(F.when(~rated, F.col("intensity"))).alias("intensity"),
    )


def _polarity_in_place(articles: DataFrame, lexicon: DataFrame, text: str, score: str) -> DataFrame:
    # The lexicon as an array of hash buckets, so that a word is looked up without a scan of all entries.
    def bucket(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(LEXICON_BUCKETS)).cast("int")

    filled = lexicon.groupBy(bucket(F.col("word")).alias("bucket")).agg(
        F.collect_list(F.struct("word", "polarity", "intensity")).alias("entries")
    )
    numbers = lexicon.sparkSession.range(LEXICON_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "entries")))
    table = numbers.join(filled, "bucket", "left").agg(F.transform(ordered, lambda b: b["entries"]).alias("t")).scalar()

    def entry(word: Column) -> Column:
        return F.get(F.filter(F.get(F.col("_lexicon"), bucket(word)), lambda e: e["word"] == word), F.lit(0))

    words, entries = F.col("_found_words"), F.col("_entries")

    def value(found: Column, at: Column) -> Column:
        scale = F.when(at > 0, F.get(entries, at - 1))["intensity"]
        return _clip(found["polarity"] * F.coalesce(scale, F.lit(1.0)))

    def rated(found: Column, at: Column) -> Column:
        return F.when(found["polarity"].isNotNull(), value(found, at))

    looked_up = (
        articles.withColumns({"_found_words": _words(F.col(text)), "_lexicon": table})
        .withColumn("_entries", F.transform(words, entry))
        .withColumn("_values", F.array_compact(F.transform(entries, rated)))
    )
    total = F.aggregate("_values", F.lit(0.0), lambda s, v: s + v)
    mean = F.when(F.size("_values") > 0, total / F.size("_values")).otherwise(0.0)
    return looked_up.withColumn(score, mean).drop("_found_words", "_lexicon", "_entries", "_values")


def _polarity_by_join(articles: DataFrame, lexicon: DataFrame, text: str, score: str) -> DataFrame:
    # A score depends on the text alone, so each text is scored once, under its digest.
    # The word before is paired with each word inside the row, so that no window is needed.
    # Lexicon hits are the only rows that go on, and they are summed per text before the shuffle.
    pairs = F.transform(
        F.col("_words"),
        lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get(F.col("_words"), i - 1)).alias("previous")),
    )
    keyed = articles.withColumn("_text", row_digest(text))
    texts = keyed.groupBy("_text").agg(F.first(text).alias("_spoken"))
    spoken = texts.select("_text", _words(F.col("_spoken")).alias("_words")).select("_text", F.inline(pairs))
    rated = lexicon.where(F.col("polarity").isNotNull()).select("word", "polarity")
    modifiers = lexicon.where(F.col("intensity").isNotNull()).select(F.col("word").alias("previous"), "intensity")
    hits = spoken.join(rated, "word").join(modifiers, "previous", "left")
    value = _clip(F.col("polarity") * F.coalesce(F.col("intensity"), F.lit(1.0)))
    scores = hits.groupBy("_text").agg(F.avg(value).alias(score))
    scored = keyed.join(scores, "_text", "left").withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))
    return scored.select(*articles.columns, score)


#: What scores a text: a lexicon(word, polarity, intensity), or a function from a text column to a number column.
Scorer = DataFrame | Callable[[Column], Column]


def score_sentiment(articles: DataFrame, scorer: Scorer, text: str = "summary", score: str = "custom_sentiment_score") -> DataFrame:
    """Polarity of a text by a lexicon, or by any function of columns, such as an Arrow pandas UDF around a model.

    A function's NULL or NaN counts as 0, and its result is kept within -1 and 1, as a lexicon's is.
    """
    if isinstance(scorer, DataFrame):
        return lexicon_polarity(articles, scorer, text, score)
    value = V.finite(scorer(F.coalesce(F.col(text), F.lit(""))).cast("double"))
    return articles.withColumn(score, _clip(F.coalesce(value, F.lit(0.0))))


def label_sentiment(df: DataFrame, score: str = "custom_sentiment_score",
                    label: str = "custom_sentiment_label") -> DataFrame:
    return df.withColumn(label, V.sentiment_label(F.col(score)))


def project_news(feed: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Feed items in table shape. Missing texts become '', a missing score 0 and a missing label Unknown."""

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    return feed.select(
        *extra,
        text("title").alias("headline"),
        text("summary").alias("summary"),
        F.coalesce(F.col("overall_sentiment_score"), F.lit(0.0)).alias("original_sentiment_score"),
        text("overall_sentiment_label", "Unknown").alias("original_sentiment_label"),
        text("source").alias("source"),
        text("time_published").alias("published_at"),
    )


def project_variant_news(records: DataFrame, column: str = "item", extra: Sequence[str] = ()) -> DataFrame:
    """As `project_news`, from variant records: a default replaces a missing key, a JSON null stays NULL."""
    item = F.col(column)
    return records.select(
        *extra,
        V.variant_field(item, "$.title", "string", "").alias("headline"),
        V.variant_field(item, "$.summary", "string", "").alias("summary"),
        V.variant_field(item, "$.overall_sentiment_score", "double", 0.0).alias("original_sentiment_score"),
        V.variant_field(item, "$.overall_sentiment_label", "string", "Unknown").alias("original_sentiment_label"),
        V.variant_field(item, "$.source", "string", "").alias("source"),
        V.variant_field(item, "$.time_published", "string", "").alias("published_at"),
    )


def dedup_news_first(articles: DataFrame, order: Sequence[str] = ("feed_pos",)) -> DataFrame:
    """First article per headline, summary, source and publication time, in feed order."""
    return keep_first(articles, NEWS_KEY, [F.col(c).asc_nulls_last() for c in order], long_keys=True)


def parse_published(articles: DataFrame) -> DataFrame:
    return articles.withColumn("published_at", V.to_published(F.col("published_at")))


def split_unpublished(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles with a publication time that parses, and those without (as they arrived)."""
    parsed = V.to_published(F.col("published_at"))
    return parse_published(articles.where(parsed.isNotNull())), articles.where(parsed.isNull())


def dedup_full_row(df: DataFrame) -> DataFrame:
    return df.distinct()


def news_search(news: DataFrame, keyword: str) -> DataFrame:
    """Articles whose headline or summary holds the keyword in any case, newest first."""
    wanted = keyword.lower()
    hit = F.lower("headline").contains(wanted) | F.lower("summary").contains(wanted)
    return (
        news.where(hit)
        .select("headline", "summary", "custom_sentiment_score", "custom_sentiment_label", "published_at")
        .orderBy(F.desc("published_at"), "headline", "summary")
    )


def article_card(news: DataFrame, position: int, order: Sequence[Column] | None = None) -> DataFrame:
    """Details and card text of the article at a 0-based position of a newest-first list."""
    first = order or [F.desc_nulls_last("published_at"), F.asc("headline"), F.asc("summary")]
    # Sorting with a limit first keeps the final numbering to position + 1 rows.
    upto = news.orderBy(*first).limit(position + 1)
    numbered = upto.withColumn("_n", F.row_number().over(Window.orderBy(*first)))
    card = F.format_string(CARD, F.col("headline"), F.col("summary"), F.col("custom_sentiment_label"))
    return numbered.where(F.col("_n") == position + 1).select(
        "headline",
        V.timestamp_text(F.col("published_at")).alias("published_text"),
        "summary",
        V.two_decimals(F.col("custom_sentiment_score")).alias("score_text"),
        "custom_sentiment_label",
        card.alias("card"),
    )
