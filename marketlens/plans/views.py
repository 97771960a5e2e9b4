"""Views of the given parquet tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions.values import hash_bucket

# A lexicon of words that occur in the documents. Scores are binary fractions,
# whose sums do not depend on the order of addition.
TEST_LEXICON = [
    ("the", 0.25, 1.0), ("that", -0.375, 1.0), ("in", 0.5, 1.0), ("an", -0.625, 1.0), ("les", 0.375, 1.0),
    ("von", -0.5, 1.0), ("est", 0.75, 1.0), ("der", 0.125, 1.0), ("por", -0.25, 1.0),
    ("and", 0.0, 1.5), ("de", 0.0, -0.5), ("und", 0.0, 0.5), ("to", 0.0, 1.25),
]
# Names that stand for symbols in the generated questions.
TEST_NAMES = {"microsoft": "S1", "apple": "S2", "netflix": "S3", "nvidia": "S4", "amazon": "S5"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: one row per symbol and ship date of lineitem."""
    items = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    # Order and line (a digit below 16), then the price in cents, as one number: a struct here would make Spark sort all rows.
    line = (F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("decimal(20,0)")
    order = line * F.lit(10**12).cast("decimal(13,0)") + F.round(price * 100).cast("decimal(12,0)")
    return items.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("trade_date")
    ).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per event type and user group; events are in time order by id."""
    events = table(spark, sf_dir, "events")
    value = F.col("value")
    return events.groupBy(
        F.concat_ws("_", "event_type", (F.col("user_id") % 5).cast("string")).alias("symbol"),
        F.to_date("ts").alias("trade_date"),
    ).agg(
        F.min_by(value, "event_id").alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, "event_id").alias("close"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("volume"),
    )


def _noise(buckets: int) -> Column:
    return hash_bucket(F.concat_ws("|", F.col("symbol"), F.col("trade_date").cast("string")), buckets)


def raw_bars(bars: DataFrame) -> DataFrame:
    """Bars as landing text, some of them dirty: which ones depends on a hash of symbol and date."""
    noise = F.col("_noise")
    date, open_, volume = (F.col(c).cast("string") for c in ("trade_date", "open", "volume"))
    return bars.withColumn("_noise", _noise(20)).select(
        "symbol",
        F.when(noise == 3, F.concat(F.lit("x"), date)).otherwise(date).alias("date"),
        F.when(noise == 0, "abc").when(noise == 1, F.lit(None)).when(noise == 4, "NaN")
        .when(noise == 6, "1_000").otherwise(open_).alias("open"),
        *[F.col(c).cast("string").alias(c) for c in ("high", "low", "close")],
        F.when(noise == 2, F.lit(None)).when(noise == 5, F.concat(volume, F.lit(".5"))).otherwise(volume).alias("volume"),
    )


def series_documents(raw: DataFrame) -> DataFrame:
    """Landing documents, one per symbol and month; missing values have no key. A month has few days."""
    def day(row: Column) -> Column:
        fields = [F.struct(F.lit(f).alias("key"), row[c].alias("value")) for c, f in S.BAR_FIELDS.items()]
        return F.map_from_entries(F.filter(F.array(*fields), lambda e: e["value"].isNotNull()))

    # Only values travel; the names of the fields are put to them in their document.
    months = raw.groupBy("symbol", F.substring("date", 1, 7).alias("month")).agg(
        F.collect_list(F.struct("date", *S.BAR_FIELDS)).alias("days"))
    return months.withColumn(
        S.SERIES_KEY, F.map_from_entries(F.transform("days", lambda d: F.struct(d["date"], day(d))))
    ).select(
        "symbol",
        F.create_map(F.lit("2. Symbol"), F.col("symbol")).alias(S.META_KEY),
        S.SERIES_KEY,
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news feed over the documents: the whole text is the summary, labels give the score."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = (F.col("quality") - F.col("toxic")).cast("double")
    minute = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("SYM"), F.col("doc_id") % 5).alias("feed_symbol"),
        F.col("doc_id").alias("feed_pos"),
        F.concat_ws(" ", "source", "lang", (F.col("doc_id") % 50).cast("string")).alias("title"),
        F.col("text").alias("summary"),
        score.alias("overall_sentiment_score"),
        F.when(score > 0, "Bullish").when(score <= 0, "Bearish").alias("overall_sentiment_label"),
        "source",
        F.date_format(minute, "yyyyMMdd'T'HHmmss").alias("time_published"),
    )


def news_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed and a second copy of it, later in feed order and with some other scores."""
    once = news(spark, sf_dir)
    other = F.when(F.col("feed_pos") % 7 == 0, F.lit(0.25)).otherwise(F.col("overall_sentiment_score"))
    again = once.withColumn("overall_sentiment_score", other).withColumn("feed_pos", F.col("feed_pos") + 1000000000)
    return once.unionByName(again)


def filings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings documents per customer and range of 1,000 order keys (which bounds their arrays); some are uneven."""
    orders = table(spark, sf_dir, "orders")
    row = F.struct(
        "o_orderkey",
        F.col("o_orderpriority").alias("form"),
        F.to_date("o_orderdate").cast("string").alias("filingDate"),
        F.concat(F.lit("doc"), F.col("o_orderkey"), F.lit(".htm  ex"), F.col("o_orderstatus"), F.lit(".htm"))
        .alias("primaryDocument"),
        F.col("o_orderstatus").alias("primaryDocDescription"),
    )
    grouped = orders.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )

    def column(name: str) -> Column:
        return F.transform("rows", lambda r: r[name])

    short = F.slice(column("primaryDocDescription"), F.lit(1), F.size("rows") - 1)
    descriptions = F.when(F.col("o_custkey") % 7 == 0, short).otherwise(column("primaryDocDescription"))
    return grouped.select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("company_name"),
        F.col("o_custkey").cast("string").alias("cik"),
        F.struct(F.struct(
            column("form").alias("form"), column("filingDate").alias("filingDate"),
            column("primaryDocument").alias("primaryDocument"), descriptions.alias("primaryDocDescription"),
        ).alias("recent")).alias("filings"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over the orders: name, field, horizon and intent follow from the keys."""

    def pick(key: str, choices: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.col(key) % len(choices) + 1).cast("int"))

    name = pick("o_custkey", ["Microsoft", "APPLE", "netflix", "Nvidia", "Amazon", "nobody"])
    field = pick("o_orderkey", ["closing price", "Volume", "highest price", "lowest price", "opening price", "outlook"])
    days = pick("o_custkey", ["over the last 5 days", "for 3 days", "over 11 days", "tomorrow", "soon"])
    verb = pick("o_orderkey", ["What was the", "Predict the", "Explain the", "What is the next predicted"])
    text = F.concat(verb, F.lit(" "), field, F.lit(" of "), name, F.lit(" "), days, F.lit("?"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), text.alias("text"))


def predictions(bars: DataFrame) -> DataFrame:
    """Stored predictions of two models for every bar."""
    both = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(v).alias("_v"), F.lit(c).alias("_c"))
        for m, v, c in (("seq_a", 1.01, 1.02), ("seq_b", 0.99, 0.98))
    ])
    return bars.select("symbol", "trade_date", "volume", "close", F.inline(both)).select(
        "symbol", "trade_date",
        F.round(F.col("volume") * F.col("_v"), 4).alias("volume_prediction"),
        F.round(F.col("close") * F.col("_c"), 4).alias("close_prediction"),
        "model",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the pages of a document; every fifth is empty."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"),
        F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text")).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
