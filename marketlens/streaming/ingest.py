"""Incremental ingest with Structured Streaming: each run takes the files that are new since the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketlens import schemas as S
from marketlens.operators import news
from marketlens.operators.news import NEWS_KEY
from marketlens.operators.ranked import keep_first, row_digest
from marketlens.plans import jobs
from marketlens.sources import landing
from marketlens.sources.scratch import compiled_methods, discard, shuffles_removed, staged
from marketlens.sources.sinks import balanced

STORED_BARS = T.StructType([*S.TRADES.fields, T.StructField("trade_month", T.DateType())])
STORED_NEWS = T.StructType([
    *S.NEWS_SENTIMENT.fields, T.StructField("article_key", T.BinaryType()), T.StructField("published_date", T.DateType()),
])
REJECTED_NEWS = "headline string, summary string, source string, time_published string, line string"


def stream_series(spark: SparkSession, folder: str, lines: bool = True, files_per_batch: int = 1000,
                  name_pattern: str | None = None) -> DataFrame:
    """Daily-series documents as they land, with their symbol; `run_bars` stores what they hold."""
    docs = (
        spark.readStream.schema(landing.SERIES_SCHEMA).option("multiLine", str(not lines))
        .option("maxFilesPerTrigger", files_per_batch).json(folder)
    )
    return docs.withColumn("symbol", landing.series_symbol(name_pattern))


def _stored(rows: DataFrame, path: str, schema: T.StructType, part: str) -> DataFrame:
    """What is stored in the partitions of some rows; no other is read."""
    parts = [r[0] for r in rows.select(part).distinct().collect()]  # at most the days (or months) of the calendar
    here = F.col(part).isin([p for p in parts if p is not None])
    return rows.sparkSession.read.schema(schema).parquet(path).where(here | F.col(part).isNull() if None in parts else here)


def _store(rows: DataFrame, path: str, schema: T.StructType, part: str) -> None:
    with shuffles_removed(rows.sparkSession):
        balanced(rows.select(*schema.names), part).write.mode("append").partitionBy(part).parquet(path)


def _store_unseen(rows: DataFrame, path: str, schema: T.StructType, key: str, part: str, shape=None) -> None:
    """Append the rows whose key is not stored yet."""
    held = _stored(rows, path, schema, part).select(F.col(part), F.col(key))
    same = rows[part].eqNullSafe(held[part]) & (rows[key] == held[key])
    fresh = rows.join(held, same, "left_anti")
    _store(shape(fresh) if shape else fresh, path, schema, part)


def _store_new_bars(bars: DataFrame, path: str) -> None:
    """Append each bar that is not stored yet, once. New and stored bars meet in one grouping: no key of a bar is made or kept."""
    held = _stored(bars, path, STORED_BARS, "trade_month")
    both = bars.select(*S.TRADES.names, F.lit(False).alias("_held")).unionByName(held.select(*S.TRADES.names, F.lit(True).alias("_held")))
    fresh = both.groupBy(*S.TRADES.names).agg(F.max("_held").alias("_held")).where(~F.col("_held"))
    _store(fresh.withColumn("trade_month", F.trunc("trade_date", "month")), path, STORED_BARS, "trade_month")


def _run(stream: DataFrame, store, checkpoint: str) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_bars(docs: DataFrame, path: str, rejected: str, checkpoint: str, start: str = "2023-05-01") -> StreamingQuery:
    """Process the documents that are there, then stop: the bars of the batch job, each stored once however often it lands.

    What is stored is itself the state: a batch is compared with the bars of its own months, which are partitions, so nothing
    expires and a batch that is run again adds nothing. A batch is parsed once and written once before it is stored. Every batch writes what it sets aside, with a reason, to its part of `rejected`.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], STORED_BARS).write.mode("append").partitionBy("trade_month").parquet(path)

    def store(batch: DataFrame, number: int) -> None:
        with compiled_methods(batch.sparkSession):
            judged = jobs.judged_bars(batch, start).withColumn("trade_month", F.trunc("trade_date", "month"))
            rows = staged(judged, "batch-bars", "zstd")
            wrong = rows.where(F.col("reason").isNotNull()).select("symbol", "arrived.*", "reason")
            wrong.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            _store_new_bars(rows.where(F.col("reason").isNull()), path)
        discard(rows)

    return _run(docs, store, checkpoint)


def stream_news(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of feed files as they land (an item or an array of items each); `run_news` stores each article once."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select("value", "_metadata")


def run_news(stream: DataFrame, path: str, rejected: str, checkpoint: str, scorer: news.Scorer | None = None) -> StreamingQuery:
    """Process everything that is there, then stop. Each article is stored once, scored, however late it comes.

    Of the same article in one batch the first in file order stays. A batch is compared with the stored keys of its own dates,
    which are partitions; only articles that are new are scored. Lines that are not JSON and items whose publication time does
    not parse go to `rejected`. A batch that is run again adds nothing. `scorer` is the standard lexicon if none is given.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], STORED_NEWS).write.mode("append").partitionBy("published_date").parquet(path)
    chosen = news.lexicon_frame(spark) if scorer is None else scorer

    def scored(articles: DataFrame) -> DataFrame:
        return news.label_sentiment(news.score_sentiment(articles, chosen))

    def store(batch: DataFrame, number: int) -> None:
        # Lines are read from the landed files where they are used; only the items are written, once, and what is left of them.
        lines = batch.select("value", *landing.feed_place())
        items = staged(news.project_variant_news(landing.variant_items(lines, []), extra=["feed_order"]), "news-items", "zstd")
        published, unpublished = news.split_unpublished(items)
        unreadable = batch.select("value").where((F.trim("value") != "") & F.try_parse_json("value").isNull())
        left_out = unpublished.select("headline", "summary", "source", F.col("published_at").alias("time_published")).unionByName(
            unreadable.select(F.col("value").alias("line")), allowMissingColumns=True)
        left_out.to(T._parse_datatype_string(REJECTED_NEWS)).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        keyed = published.withColumns({"article_key": row_digest(*NEWS_KEY), "published_date": F.to_date("published_at")})
        first = staged(keep_first(keyed, ["published_date", "article_key"], [F.asc("feed_order")]), "news-first", "zstd")
        _store_unseen(first, path, STORED_NEWS, "article_key", "published_date", scored)
        discard(items, first)

    return _run(stream, store, checkpoint)
