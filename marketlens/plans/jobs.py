"""The four chains as plain functions over DataFrames and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions import values as V
from marketlens.operators import features as X
from marketlens.operators import filings, forecast, news, questions, retrieval, series, sliding
from marketlens.sources import landing, sinks
from marketlens.sources.scratch import compiled_methods, staged

# Sequence models by the name their predictions are stored under.
SEQUENCE_KINDS = {"seq_a": "linear", "seq_b": "reservoir"}


# --- stock bars -----------------------------------------------------------------

def bars_from_documents(docs: DataFrame, start: str = "2023-05-01") -> DataFrame:
    """Series documents to clean trades: gate, start date, flatten, reject, type, distinct."""
    valid, _ = series.gate_documents(docs)
    good, _ = series.split_bad_numbers(series.flatten_series(series.filter_start_date(valid, start)))
    return series.clean_trades(good)


def rejected_bars(docs: DataFrame, start: str = "2023-05-01") -> DataFrame:
    """What `bars_from_documents` leaves out, with a reason: documents without their key, bad numbers, fractional volumes, no symbol.

    A row has symbol, date and values as the text they arrived in; a rejected document has only its symbol.
    """
    valid, gated = series.gate_documents(docs)
    raw = series.flatten_series(series.filter_start_date(valid, start))
    good, bad = series.split_bad_numbers(raw)
    as_text = {c: F.col(c).cast("string") for c in X.BAR_VALUES}
    nothing = {c: F.lit(None).cast("string") for c in ("date", *X.BAR_VALUES)}
    why = F.when(V.is_fractional(F.col("volume")), "volume").when(F.col("symbol").isNull(), "symbol")
    parts = [
        gated.select("symbol").withColumns(nothing).withColumn("reason", F.lit("document")),
        bad.withColumn("reason", F.concat(F.lit("number: "), "bad_columns")),
        good.withColumn("reason", why).where(F.col("reason").isNotNull()).withColumns(as_text),
    ]
    columns = ["symbol", "date", *X.BAR_VALUES, "reason"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def judged_bars(docs: DataFrame, start: str = "2023-05-01") -> DataFrame:
    """Both of these in one pass over the documents: rows with no `reason` are the bars that `bars_from_documents` keeps, repeats
    included; the others are those of `rejected_bars`, whose date and values as text are in `arrived`."""
    rows = series.judge_numbers(series.flatten_gated(series.filter_start_date(docs, start)))
    numbers = {c: F.col(f"{c}_number") for c in X.BAR_VALUES}
    bad = F.col("bad_columns") != ""
    why = (F.when(F.col("gated"), "document").when(bad, F.concat(F.lit("number: "), "bad_columns"))
           .when(V.is_fractional(numbers["volume"]), "volume").when(F.col("symbol").isNull(), "symbol"))
    judged = rows.withColumn("reason", why)
    fits = F.col("reason").isNull()
    text = [F.when(bad, F.col(c)).otherwise(n.cast("string")).alias(c) for c, n in numbers.items()]
    values = [F.when(fits, n).alias(c) for c, n in numbers.items()]
    records = judged.select("symbol", "date", *values, "reason", F.when(~fits, F.struct("date", *text)).alias("arrived"))
    return series.type_records(records, ["reason", "arrived"])


def load_trades(spark: SparkSession, landing_path: str, table: str, start: str = "2023-05-01",
                lines: bool = False, name_pattern: str | None = None) -> DataFrame:
    """Append the bars the table does not hold yet; returns what was set aside."""
    docs = landing.read_series(spark, landing_path, lines, name_pattern)
    rejected = staged(rejected_bars(docs, start), "rejected-bars")
    sinks.append_new_rows(bars_from_documents(docs, start), table, ["symbol", "trade_date", *X.BAR_VALUES], within="trade_date")
    return rejected


def build_features(bars: DataFrame) -> DataFrame:
    """Cleaned trades to raw features (before scaling). The clean bars are written first: features read them twice."""
    return X.lag_features(staged(series.clean_table(bars, keep=bars.columns), "clean-bars"))


def stored_features(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw features and the moments of the columns that are scaled, both written."""
    with compiled_methods(bars.sparkSession):
        raw = staged(build_features(bars), "features", "zstd")
        moments = staged(X.column_moments(raw, X.scaled_columns(raw.columns)), "moments")
    return raw, moments


def scaled_features(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Standardised features, and the moments they were scaled with. Raw features and moments are written first."""
    raw, moments = stored_features(bars)
    return _standardized(raw, moments), moments


def _standardized(raw: DataFrame, moments: DataFrame) -> DataFrame:
    return X.standardize(raw, X.scaled_columns(raw.columns), moments=moments)


def _training(features: DataFrame) -> DataFrame:
    return X.random_split(features, ["symbol", "trade_date"]).where(F.col("split") == "train").drop("split")


def store_features(bars: DataFrame, path: str, run_ts: str, seed: int = 42) -> None:
    """Standardised features with split labels, as one run of a snapshot table."""
    scaled, _ = scaled_features(bars)
    sinks.write_snapshot(X.random_split(scaled, ["symbol", "trade_date"], seed), path, run_ts)


def forecast_trades(bars: DataFrame, as_of: str, models: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Forecasts by model name. Features are written once before the fits, which read them several times.

    `models` maps any of rf, gbt, seq_a (linear) and seq_b (recurrent) to settings.
    """
    wanted = models if models is not None else {"rf": {}, "gbt": {}, "seq_a": {}, "seq_b": {}}
    out = {}
    if {"rf", "gbt"} & set(wanted):
        raw, moments = stored_features(bars)
        newest = _standardized(raw, moments)
        if "rf" in wanted:
            # Neighbouring rows share most raw lags, which a shuffle packs well; scaled ones all differ. So rows are dealt before.
            dealt = _standardized(raw.repartition("symbol"), moments)
            out["rf"] = forecast.forecast_flat(_training(dealt), newest, as_of, **wanted["rf"])
        if "gbt" in wanted:
            out["gbt"] = forecast.forecast_recursive(_training(newest), newest, moments, as_of, **wanted["gbt"])
    sequences = [name for name in SEQUENCE_KINDS if name in wanted]
    parts = SequenceParts(bars) if sequences else None
    for name in sequences:
        fitted = forecast.fit_sequences(parts.train, SEQUENCE_KINDS[name], **wanted[name])
        out[name] = forecast.forecast_sequences(fitted, parts.last, parts.limits, as_of)
    return out


def score_trades(bars: DataFrame, models: dict[str, dict]) -> DataFrame:
    """Held-out error per symbol and sequence model, beside that of the training mean: rows of the model_metrics table."""
    scores = {}
    parts = SequenceParts(bars)
    means = staged(forecast.error_of_means(parts.train, parts.test, parts.limits), "mean-errors")
    for name, settings in models.items():
        fitted = forecast.fit_sequences(parts.train, SEQUENCE_KINDS[name], **settings)
        scores[name] = forecast.score_sequences(fitted, parts.test, parts.limits).join(means, "symbol")
    return forecast.union_forecasts(scores)


class SequenceParts:
    """The series of each symbol, one row each: their limits, the windows before and after the split in time, and the newest sequence."""

    def __init__(self, bars: DataFrame) -> None:
        rows = staged(sliding.bar_series(series.dedup_bar_first(bars)), "series")
        self.limits = rows.select("symbol", *sliding.limit_columns())
        self.train, self.test = sliding.Windows(rows, train=True), sliding.Windows(rows, train=False)
        self.last = sliding.last_windows(rows)


def store_forecasts(forecasts: dict[str, DataFrame], table: str) -> None:
    for model, df in forecasts.items():
        sinks.replace_model(df, table, model)


# --- news ------------------------------------------------------------------------

def _first_articles(feed: DataFrame) -> DataFrame:
    place = "feed_order" if "feed_order" in feed.columns else "feed_pos"
    project = news.project_variant_news if "item" in feed.columns else news.project_news
    shaped = project(feed, extra=["feed_symbol", place])
    order = [F.asc(place), F.asc_nulls_last("original_sentiment_score"), F.asc("original_sentiment_label")]
    return news.keep_first(shaped, ["feed_symbol", *news.NEWS_KEY], order, long_keys=True)


def news_from_feed(feed: DataFrame, scorer: news.Scorer) -> DataFrame:
    """Feed items(feed_symbol, feed_pos or feed_order, ...) to the typed, distinct news table.

    Items may be columns or variants; of a variant, a JSON null stays NULL. `scorer` is a lexicon or a function of columns.
    """
    published, _ = news.split_unpublished(_first_articles(feed))
    scored = news.label_sentiment(news.score_sentiment(published, scorer))
    return sinks.conform(scored, S.NEWS_SENTIMENT).distinct()


def rejected_news(feed: DataFrame) -> DataFrame:
    """The articles that `news_from_feed` leaves out for want of a publication time that parses, as they arrived."""
    return news.split_unpublished(_first_articles(feed))[1]


def load_news(feed: DataFrame, scorer: news.Scorer, table: str) -> DataFrame:
    """Append the rows that the news table does not hold; returns the articles that were set aside.

    The feed's rows are distinct, so the table stays so without being rewritten; only the range of their times is read.
    """
    rejected = staged(rejected_news(feed), "rejected-news")
    sinks.append_new_rows(news_from_feed(feed, scorer), table, S.NEWS_SENTIMENT.names, within="published_at")
    return rejected


def load_news_files(spark: SparkSession, landing_path: str, scorer: news.Scorer, table: str, lines: bool = False,
                    name_pattern: str = landing.NEWS_NAME) -> DataFrame:
    """`load_news` from landed files, one feed per symbol: defaults for missing keys only, first articles by file order."""
    return load_news(landing.read_news_variant(spark, landing_path, lines, name_pattern), scorer, table)


# --- filings ---------------------------------------------------------------------

def filings_from_files(spark: SparkSession, landing_path: str, lines: bool = False, name_pattern: str = landing.FILINGS_NAME,
                       ciks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Filings of readable documents, named through `ciks`(symbol, cik), and what was set aside."""
    docs, unreadable = landing.read_filings(spark, landing_path, lines, name_pattern)
    named = filings.name_companies(docs, filings.cik_frame(spark) if ciks is None else ciks)
    return filings.flatten_filings(named), unreadable


def load_filings(spark: SparkSession, landing_path: str, table: str, lines: bool = False,
                 name_pattern: str = landing.FILINGS_NAME, ciks: DataFrame | None = None) -> DataFrame:
    """Append the filings of readable documents; returns what was set aside."""
    found, unreadable = filings_from_files(spark, landing_path, lines, name_pattern, ciks)
    sinks.append_table(found, table)
    return unreadable


# --- questions and documents -------------------------------------------------------

def answer_questions(asked: DataFrame, bars: DataFrame, predictions: DataFrame, model: str = "seq_a",
                     names: dict[str, str] = questions.STOCK_NAMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """History answers, prediction answers, and the questions left for free-text answering."""
    routed = questions.route_questions(asked, names)
    return (
        questions.answer_history(routed, bars),
        questions.answer_prediction(routed, predictions, model),
        routed.where(F.col("route") == "free_text"),
    )


def index_pages(pages: DataFrame, embedder: PipelineModel | None = None) -> tuple[DataFrame, PipelineModel]:
    """Pages to embedded chunks; fits the embedder if none is given."""
    chunks = retrieval.chunk_pages(pages)
    model = embedder or retrieval.fit_embedder(chunks)
    return retrieval.embed_text(chunks, model), model


def retrieve(asked: DataFrame, chunks: DataFrame, model: PipelineModel, k: int = 5) -> DataFrame:
    """Prompts for asked(query_id, question) from embedded chunks(vec_id, text, embedding)."""
    queries = retrieval.embed_text(asked.withColumnRenamed("question", "text"), model)
    hits = retrieval.vector_topk(queries.select("query_id", "embedding"), chunks, k)
    context = retrieval.rag_context(hits, chunks.select("vec_id", "text"))
    return retrieval.build_prompt(context.join(asked, "query_id"))
