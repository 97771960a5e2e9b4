"""Declared schemas of landing documents and tables, and table creation."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# --- landing documents -------------------------------------------------------

SERIES_KEY = "Time Series (Daily)"
META_KEY = "Meta Data"
META_SYMBOL = "2. Symbol"

# Names of the daily-series fields in the landing documents.
BAR_FIELDS = {
    "open": "1. open",
    "high": "2. high",
    "low": "3. low",
    "close": "4. close",
    "volume": "6. volume",
}
PRICES = ["open", "high", "low", "close"]

_text_map = T.MapType(T.StringType(), T.StringType())

SERIES_DOC = T.StructType([
    T.StructField(META_KEY, _text_map),
    T.StructField(SERIES_KEY, T.MapType(T.StringType(), _text_map)),
])

BAR_RECORD = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in [*PRICES, "volume"]]
)

NEWS_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("overall_sentiment_score", T.DoubleType()),
    T.StructField("overall_sentiment_label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("time_published", T.StringType()),
])

_texts = T.ArrayType(T.StringType())
FILINGS_DOC = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("filings", T.StructType([
        T.StructField("recent", T.StructType([
            T.StructField("form", _texts),
            T.StructField("filingDate", _texts),
            T.StructField("primaryDocument", _texts),
            T.StructField("primaryDocDescription", _texts),
        ])),
    ])),
])

# --- tables ------------------------------------------------------------------

TRADES = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("trade_date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICES]
    + [T.StructField("volume", T.LongType())]
)

YEAR_END_REPORTS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("year", T.LongType())]
    + [T.StructField(c, T.DoubleType())
       for c in ["total_revenue", "net_income", "eps", "assets", "liabilities", "equity"]]
)

NEWS_SENTIMENT = T.StructType([
    T.StructField("headline", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("original_sentiment_score", T.DoubleType()),
    T.StructField("original_sentiment_label", T.StringType()),
    T.StructField("custom_sentiment_score", T.DoubleType()),
    T.StructField("custom_sentiment_label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
])

FILINGS_10K = T.StructType([
    T.StructField("company_name", T.StringType()),
    T.StructField("cik", T.StringType()),
    T.StructField("form_type", T.StringType()),
    T.StructField("filing_date", T.StringType()),
    T.StructField("document_links", _texts),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("trade_date", T.DateType()),
    T.StructField("volume_prediction", T.DoubleType()),
    T.StructField("close_prediction", T.DoubleType()),
])

MODEL_METRICS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("mse_volume", T.DoubleType()),
    T.StructField("mse_close", T.DoubleType()),
    T.StructField("model", T.StringType()),
])


# name -> (schema, partition columns). Predictions of all models share one table,
# partitioned by model, so that choosing a model prunes partitions.
TABLES = {
    "trades": (TRADES, []),
    "year_end_reports": (YEAR_END_REPORTS, []),
    "news_sentiment": (NEWS_SENTIMENT, []),
    "filings_10k": (FILINGS_10K, []),
    "model_metrics": (MODEL_METRICS, ["model"]),
    "predictions": (T.StructType([*PREDICTIONS.fields, T.StructField("model", T.StringType())]), ["model"]),
}


def _ddl_type(kind: T.DataType) -> str:
    # Field names such as `from` and `to` are keywords, so nested names are quoted.
    if isinstance(kind, T.StructType):
        return "STRUCT<" + ", ".join(f"`{f.name}`: {_ddl_type(f.dataType)}" for f in kind) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_ddl_type(kind.elementType)}>"
    return kind.simpleString()


def create_tables(spark: SparkSession, database: str, only: list[str] | None = None) -> list[str]:
    """Create the database and its parquet tables where they are absent; returns the names created."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    created = []
    for name in only or list(TABLES):
        schema, partitions = TABLES[name]
        if spark.catalog.tableExists(f"{database}.{name}"):
            continue
        columns = ", ".join(f"`{f.name}` {_ddl_type(f.dataType)}" for f in schema)
        by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet{by}")
        created.append(name)
    return created
