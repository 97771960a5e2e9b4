"""Registered queries over daily bars: sources, cleaning, features, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas as S
from marketlens.functions import values as V
from marketlens.operators import features as X
from marketlens.operators import forecast, series
from marketlens.plans import jobs, views
from marketlens.plans import sql_views as Q
from marketlens.plans.registry import query
from marketlens.sources import landing, sinks
from marketlens.sources.scratch import discard, new_path, staged
from marketlens.streaming import ingest

BARS = Q.with_views(Q.TRADES)
NOISY = Q.with_views(Q.TRADES, Q.NOISY)
BAR_TEXT = 'symbol, CAST(trade_date AS VARCHAR) AS trade_date, open, high, low, "close", volume'
PLAIN = BARS + f"SELECT {BAR_TEXT} FROM trades"
AS_OF = "1999-01-01"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raw_bars(views.trades(spark, sf_dir))


def _clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.trades(spark, sf_dir)
    return views.series_documents(
        bars.select("symbol", F.col("trade_date").cast("string").alias("date"),
                    *[F.col(c).cast("string").alias(c) for c in X.BAR_VALUES])
    )


# --- sources and sinks ---------------------------------------------------------

@query("scan_series_json", PLAIN)
def scan_series_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "series")
    _clean_documents(spark, sf_dir).write.json(path)
    docs = landing.read_series(spark, path, lines=True)
    return jobs.bars_from_documents(docs, start="1900-01-01")


@query("scan_records_json", PLAIN)
def scan_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records")
    bars = views.trades(spark, sf_dir).withColumn("volume", F.col("volume").cast("double"))
    bars.withColumnRenamed("trade_date", "date").write.json(path)
    return series.clean_trades(landing.read_records(spark, path, lines=True))


@query("scan_trades", PLAIN)
def scan_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "trades")
    views.trades(spark, sf_dir).write.parquet(path)
    return spark.read.schema(S.TRADES).parquet(path)


@query("scan_csv", PLAIN)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    sinks.write_csv(views.trades(spark, sf_dir), path)
    return landing.read_csv(spark, path, S.TRADES)


@query("fanin_symbol", BARS + """
SELECT symbol, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume FROM trades GROUP BY symbol""")
def fanin_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fanin")
    sinks.write_json(views.trades(spark, sf_dir), path)
    with landing.listed_in_few_tasks(spark):
        flat = spark.read.schema("volume long").option("recursiveFileLookup", "true").json(path)
    named = landing.symbol_from_name(flat, r"symbol=([^/]+)/")
    return named.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))


@query("sink_json_roundtrip", PLAIN)
def sink_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    bars = staged(views.trades(spark, sf_dir), "json-bars", "zstd")
    for _ in range(2):
        sinks.write_json(bars, path, compression="gzip")
    discard(bars)
    with landing.listed_in_few_tasks(spark):
        return spark.read.schema(S.TRADES).json(path).select(*S.TRADES.names)


@query("sink_csv_roundtrip", BARS + """
SELECT symbol, count(*) AS bars, min(low) AS low, max(high) AS high, CAST(sum(volume) AS BIGINT) AS volume
FROM trades GROUP BY symbol""")
def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = scan_csv(spark, sf_dir)
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("volume").alias("volume"),
    )


@query("latest_snapshot", BARS + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, "close" * 2 AS "close" FROM trades""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "snapshots")
    bars = views.trades(spark, sf_dir).select("symbol", "trade_date", "close")
    sinks.write_csv(bars, f"{folder}/train_bars_20240101000000.csv")
    sinks.write_csv(bars.withColumn("close", F.col("close") * 2), f"{folder}/train_bars_20240301120000.csv")
    schema = "symbol string, trade_date date, close double"
    return landing.read_latest_csv(spark, folder, r"train_bars_(\d{14})\.csv", T._parse_datatype_string(schema))


@query("latest_run", BARS + f"""
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, "close", '20240301120000' AS run_ts, 'train' AS split FROM trades
WHERE {Q.hash_bucket("symbol || '|' || CAST(trade_date AS VARCHAR) || '|42'", 10000)} < 8000""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "runs")
    bars = views.trades(spark, sf_dir).select("symbol", "trade_date", "close")
    split = X.random_split(bars, ["symbol", "trade_date"])
    sinks.write_snapshot(split.withColumn("close", F.col("close") * 2), path, "20240101000000")
    sinks.write_snapshot(split, path, "20240301120000")
    runs = landing.read_latest_run(spark, path, "train")
    return runs.withColumn("run_ts", F.col("run_ts").cast("string"))


@query("append_then_distinct", PLAIN)
def append_then_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "append")
    bars = views.trades(spark, sf_dir)
    for _ in range(2):
        sinks.guard_dates(bars).write.mode("append").parquet(path)
    return spark.read.schema(S.TRADES).parquet(path).distinct()


@query("preview_rows", BARS + f"SELECT {BAR_TEXT} FROM trades ORDER BY symbol, trade_date LIMIT 5")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.preview(series.sort_bars(views.trades(spark, sf_dir)))


@query("quarantine_rows", NOISY + """
SELECT symbol, CASE WHEN noise = 3 THEN 'x' || CAST(trade_date AS VARCHAR) ELSE CAST(trade_date AS VARCHAR) END AS date,
  CASE WHEN noise = 0 THEN 'abc' WHEN noise = 3 THEN 'date' WHEN noise = 5 THEN 'volume' ELSE 'open' END AS reason
FROM noisy WHERE noise IN (0, 3, 5, 6)""")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    typed = raw.withColumnRenamed("date", "trade_date").withColumn("open", F.nullif(F.col("open"), F.lit("NaN")))
    _, bad = sinks.split_conforming(typed, S.TRADES, required=["symbol", "trade_date"])
    reason = (F.when(F.col("open") == "abc", "abc").when(F.col("open") == "1_000", "open")
              .when(F.col("trade_date").startswith("x"), "date").otherwise("volume"))
    return bad.select("symbol", F.col("trade_date").alias("date"), reason.alias("reason"))


def _streamed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars and rejects of documents that land twice, one run for each landing; symbols are in the meta data alone."""
    landed, out, rejected, checkpoint = (new_path(spark, n) for n in ("landing", "bars", "rejected", "progress"))
    docs = staged(docs.drop("symbol"), "documents", "zstd")
    for _ in range(2):
        docs.write.mode("append").json(landed, compression="gzip")
        ingest.run_bars(ingest.stream_series(spark, landed), out, rejected, checkpoint, start="1900-01-01")
    discard(docs)
    bars = spark.read.schema(ingest.STORED_BARS).parquet(out).select(*S.TRADES.names)
    return bars, spark.read.parquet(rejected)


@query("stream_bars", PLAIN)
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, _clean_documents(spark, sf_dir))[0]


DIRTY_DATE = "CASE WHEN noise = 3 THEN 'x' || CAST(trade_date AS VARCHAR) ELSE CAST(trade_date AS VARCHAR) END"


@query("stream_bars_dirty", NOISY + """
SELECT DISTINCT symbol, CASE WHEN noise <> 3 THEN CAST(trade_date AS VARCHAR) END AS trade_date,
  CASE WHEN noise NOT IN (1, 4) THEN open END AS open, high, low, "close", CASE WHEN noise = 2 THEN 0 ELSE volume END AS volume
FROM noisy WHERE noise NOT IN (0, 5, 6)""")
def stream_bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, views.series_documents(_raw(spark, sf_dir)))[0]


@query("stream_bars_rejected", NOISY + f"""
SELECT symbol, {DIRTY_DATE} AS date, CASE WHEN noise = 5 THEN 'volume' ELSE 'number: open' END AS reason, 2 AS arrivals
FROM noisy WHERE noise IN (0, 5, 6)""")
def stream_bars_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = _streamed(spark, views.series_documents(_raw(spark, sf_dir)))
    return rejected.groupBy("symbol", "date", "reason").agg(F.count(F.lit(1)).cast("int").alias("arrivals"))


@query("bars_by_file_name", PLAIN)
def bars_by_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One folder per symbol stands for one file per symbol; the documents themselves name none.
    path = new_path(spark, "series")
    docs = _clean_documents(spark, sf_dir).withColumn("entity", F.col("symbol")).drop("symbol", S.META_KEY)
    gated = docs.withColumn(S.META_KEY, F.create_map(F.lit("1. Information"), F.lit("daily")))
    sinks.balanced(gated, "entity").write.partitionBy("entity").json(path)
    with landing.listed_in_few_tasks(spark):
        found = landing.read_series(spark, f"{path}/*", lines=True, name_pattern=r"entity=([^/]+)/")
    return jobs.bars_from_documents(found, start="1900-01-01")


# --- flattening and cleaning -----------------------------------------------------

RAW_OPEN = """CASE WHEN noise IN (1, 4) THEN NULL ELSE open END AS open"""


@query("flatten_series", NOISY + """
SELECT symbol, CASE WHEN noise = 3 THEN 'x' || CAST(trade_date AS VARCHAR) ELSE CAST(trade_date AS VARCHAR) END AS date,
  noise = 1 AS no_open, noise = 2 AS no_volume, high, low, "close" FROM noisy""")
def flatten_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = series.flatten_series(views.series_documents(_raw(spark, sf_dir)))
    return flat.select(
        "symbol", "date", F.col("open").isNull().alias("no_open"), F.col("volume").isNull().alias("no_volume"),
        *[V.to_number(F.col(c)).alias(c) for c in ("high", "low", "close")],
    )


@query("reject_bad_numbers", NOISY + f"""
SELECT symbol, CAST(trade_date AS VARCHAR) AS date, {RAW_OPEN}, high, low, "close",
  CASE WHEN noise = 2 THEN NULL WHEN noise = 5 THEN volume + 0.5 ELSE volume END::DOUBLE AS volume, false AS rejected
FROM noisy WHERE noise NOT IN (0, 3, 6)
UNION ALL SELECT symbol, CASE WHEN noise = 3 THEN 'x' || CAST(trade_date AS VARCHAR) ELSE CAST(trade_date AS VARCHAR) END,
  CASE WHEN noise = 3 THEN open END, high, low, "close", volume, noise <> 3 FROM noisy WHERE noise IN (0, 3, 6)""")
def reject_bad_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = series.split_bad_numbers(_raw(spark, sf_dir))
    rejected = series.coerce_numeric(bad.drop("bad_columns"), X.BAR_VALUES)
    return good.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))


@query("gate_documents", BARS + """
SELECT symbol, strftime(trade_date, '%Y-%m') AS month, count(*) AS days, hash_ok AS accepted FROM (
  SELECT *, """ + Q.hash_bucket("symbol || '|' || strftime(trade_date, '%Y-%m')", 10) + """ <> 0 AS hash_ok FROM trades)
GROUP BY symbol, month, hash_ok""")
def gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _clean_documents(spark, sf_dir)
    month = F.substring(F.map_keys(S.SERIES_KEY)[0], 1, 7)
    keep = V.hash_bucket(F.concat_ws("|", "symbol", month), 10) != 0
    docs = docs.withColumn(S.META_KEY, F.when(keep, F.col(f"`{S.META_KEY}`")))
    valid, rejected = series.gate_documents(docs)
    parts = [
        part.select("symbol", month.alias("month"), F.size(S.SERIES_KEY).alias("days"), F.lit(ok).alias("accepted"))
        for part, ok in ((valid, True), (rejected, False))
    ]
    return parts[0].unionByName(parts[1])


@query("filter_start_date", BARS + f"SELECT {BAR_TEXT} FROM trades WHERE trade_date >= DATE '1998-05-01'")
def filter_start_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.bars_from_documents(_clean_documents(spark, sf_dir), start="1998-05-01")


@query("filter_as_of", BARS + f"SELECT {BAR_TEXT} FROM trades WHERE trade_date <= DATE '{AS_OF}' - INTERVAL 1 DAY")
def filter_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.filter_as_of(views.trades(spark, sf_dir), AS_OF)


@query("filter_symbol", BARS + f"SELECT {BAR_TEXT} FROM trades WHERE symbol = 'S3'")
def filter_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.filter_symbol(views.trades(spark, sf_dir), "S3")


@query("drop_null_key", BARS + f"SELECT {BAR_TEXT} FROM trades WHERE volume >= 10")
def drop_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.trades(spark, sf_dir)
    return series.drop_null_key(bars.withColumn("symbol", F.when(F.col("volume") >= 10, F.col("symbol"))))


@query("drop_sparse_columns", NOISY + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, "close", volume AS mostly FROM noisy WHERE noise > 1""")
def drop_sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.trades(spark, sf_dir).withColumn("n", V.hash_bucket(
        F.concat_ws("|", "symbol", F.col("trade_date").cast("string")), 20))
    holey = bars.select(
        "symbol", "trade_date", "close",
        F.when(F.col("n") > 1, F.col("volume")).alias("mostly"),
        F.when(F.col("n") == 2, F.col("volume")).alias("rarely"),
    )
    return series.drop_sparse_columns(holey)


@query("clean_table", PLAIN)
def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.trades(spark, sf_dir)
    return series.clean_table(bars.unionByName(bars), keep=bars.columns)


@query("dedup_trades", PLAIN)
def dedup_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.trades(spark, sf_dir)
    return series.dedup_trades(bars.unionByName(bars))


@query("dedup_bar_first", BARS + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, open - 1 AS open, high, low, "close", volume FROM trades""")
def dedup_bar_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.trades(spark, sf_dir)
    return series.dedup_bar_first(bars.unionByName(bars.withColumn("open", F.col("open") - 1)))


@query("distinct_symbols", BARS + "SELECT DISTINCT symbol FROM trades")
def distinct_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.distinct_symbols(views.trades(spark, sf_dir))


@query("profile_counts", NOISY + """
SELECT 'symbol' AS column_name, count(symbol) AS non_null, count(*) AS row_count FROM noisy
UNION ALL SELECT 'date', count(*), count(*) FROM noisy
UNION ALL SELECT 'open', count(*) FILTER (noise <> 1), count(*) FROM noisy
UNION ALL SELECT 'high', count(high), count(*) FROM noisy
UNION ALL SELECT 'low', count(low), count(*) FROM noisy
UNION ALL SELECT 'close', count("close"), count(*) FROM noisy
UNION ALL SELECT 'volume', count(*) FILTER (noise <> 2), count(*) FROM noisy""")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.profile_counts(_raw(spark, sf_dir))


@query("coverage_report", BARS + f"""
SELECT symbol, CAST(min(trade_date) AS VARCHAR) AS first_date, CAST(max(trade_date) AS VARCHAR) AS last_date,
  count(*) AS bars, bool_or(trade_date = DATE '{AS_OF}') AS has_as_of,
  array_to_string(list_slice(list(CAST(trade_date AS VARCHAR) ORDER BY trade_date), 1, 5), ',') AS first_dates,
  array_to_string(list_sort(list_slice(list(CAST(trade_date AS VARCHAR) ORDER BY trade_date DESC), 1, 5)), ',') AS last_dates
FROM trades GROUP BY symbol""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.coverage_report(views.trades(spark, sf_dir), AS_OF)


@query("sort_bars", PLAIN + " ORDER BY symbol, trade_date")
def sort_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sort_bars(views.trades(spark, sf_dir))


@query("rows_to_json", BARS + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, volume, "close" FROM trades""")
def rows_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = series.rows_to_json(views.trades(spark, sf_dir).select("symbol", "trade_date", "volume", "close"))
    # Read back, because engines print doubles differently.
    return payload.select(
        F.inline(F.array(F.from_json("payload", "symbol string, trade_date string, volume long, close double")))
    )


# --- scalar functions ------------------------------------------------------------

@query("coerce_numeric", NOISY + f"""
SELECT symbol, CASE WHEN noise = 3 THEN 'x' || CAST(trade_date AS VARCHAR) ELSE CAST(trade_date AS VARCHAR) END AS date,
  CASE WHEN noise IN (0, 1, 4, 6) THEN NULL ELSE open END AS open FROM noisy""")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.coerce_numeric(_raw(spark, sf_dir), ["open"]).select("symbol", "date", "open")


@query("volume_int", NOISY + """
SELECT symbol, CASE WHEN noise = 3 THEN 'x' || CAST(trade_date AS VARCHAR) ELSE CAST(trade_date AS VARCHAR) END AS date,
  CASE WHEN noise = 2 THEN 0 ELSE volume END AS volume FROM noisy WHERE noise <> 5""")
def volume_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = series.coerce_numeric(_raw(spark, sf_dir), ["volume"])
    whole, _ = series.split_fractional_volume(typed)
    return whole.select("symbol", "date", V.to_volume(F.col("volume")).alias("volume"))


@query("coerce_date", NOISY + """
SELECT symbol, "close", CASE WHEN noise = 3 THEN NULL ELSE CAST(trade_date AS VARCHAR) END AS trade_date FROM noisy""")
def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select(
        "symbol", V.to_number(F.col("close")).alias("close"), V.to_date(F.col("date")).alias("trade_date")
    )


# --- features --------------------------------------------------------------------

def _lag_sql(source: str = "trades") -> str:
    lags = ", ".join(f'lag("{c}", {k}) OVER w AS {c}_lag_{k}' for k in range(1, 6) for c in X.BAR_VALUES)
    means = ", ".join(
        f'CASE WHEN count("{c}") OVER f = 7 THEN avg("{c}") OVER f END AS {c}_7d_avg' for c in X.ROLLED
    )
    return (
        f"features AS (SELECT *, {lags}, {means} FROM {source} "
        "WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), "
        "f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) "
        "QUALIFY row_number() OVER w > 6)"
    )


_LAGS = ", ".join(f"{c}_lag_{k}" for k in range(1, 6) for c in X.BAR_VALUES)
_ROUNDED = ", ".join(f"round({c}_7d_avg, 6) AS {c}_7d_avg" for c in X.ROLLED)
FEATURES = Q.with_views(Q.TRADES, _lag_sql())


def _rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("lag_features", FEATURES + f"SELECT {BAR_TEXT}, {_LAGS}, {_ROUNDED} FROM features")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = X.lag_features(views.trades(spark, sf_dir))
    return _rounded(features, [f"{c}_7d_avg" for c in X.ROLLED], 6)


@query("lag_features_events", Q.with_views(Q.EVENT_BARS, _lag_sql("event_bars"))
       + f"SELECT {BAR_TEXT}, {_LAGS}, {_ROUNDED} FROM features")
def lag_features_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = X.lag_features(views.event_bars(spark, sf_dir))
    return _rounded(features, [f"{c}_7d_avg" for c in X.ROLLED], 6)


@query("rolling_7d", BARS + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date,
  round(CASE WHEN count(*) OVER f = 7 THEN avg("close") OVER f END, 6) AS close_7d_avg,
  round(CASE WHEN count(*) OVER f = 7 THEN avg(volume) OVER f END, 6) AS volume_7d_avg
FROM trades WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = X.rolling_means(views.trades(spark, sf_dir))
    return _rounded(rolled, ["close_7d_avg", "volume_7d_avg"], 6).select(
        "symbol", "trade_date", "close_7d_avg", "volume_7d_avg"
    )


@query("select_features", FEATURES + f"""
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {_LAGS}, {_ROUNDED} FROM features""")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.select_features(lag_features(spark, sf_dir))


SCALED = ["close_lag_1", "volume_lag_5", "close_7d_avg", "volume_7d_avg"]
_Z = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in SCALED)
_ZS = ", ".join(
    f"round(({c} - avg({c}) OVER (PARTITION BY symbol)) / stddev_pop({c}) OVER (PARTITION BY symbol), 4) AS {c}"
    for c in SCALED
)


@query("standardize", FEATURES + f"SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {_Z} FROM features")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, _ = jobs.scaled_features(views.trades(spark, sf_dir))
    return _rounded(scaled, SCALED, 4).select("symbol", "trade_date", *SCALED)


@query("standardize_by_symbol", FEATURES + f"""
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {_ZS} FROM features""")
def standardize_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = X.lag_features(views.trades(spark, sf_dir))
    scaled = X.standardize(features, SCALED, by="symbol")
    return _rounded(scaled, SCALED, 4).select("symbol", "trade_date", *SCALED)


def _unit(column: str) -> str:
    low, high = (f'{f}("{column}") OVER (PARTITION BY symbol)' for f in ("min", "max"))
    return f'round(CASE WHEN {high} = {low} THEN 0 ELSE ("{column}" - {low}) / ({high} - {low}) END, 6) AS "{column}"'


@query("minmax_scale", BARS + f"""
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {", ".join(_unit(c) for c in X.BAR_VALUES)} FROM trades""")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.minmax_scale(views.trades(spark, sf_dir), X.BAR_VALUES), X.BAR_VALUES, 6)


@query("minmax_inverse", BARS + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, "close", CAST(volume AS DOUBLE) AS volume FROM trades""")
def minmax_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.trades(spark, sf_dir)
    limits = forecast.bar_limits(bars)
    scaled = forecast.scaled_bars(bars, limits)
    restored = X.minmax_inverse(scaled.select("symbol", "trade_date", "close", "volume"), ["close", "volume"], limits)
    return _rounded(restored, ["close", "volume"], 2)


@query("random_split", BARS + f"""
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date,
  CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'test' ELSE 'validation' END AS split
FROM (SELECT *, {Q.hash_bucket("symbol || '|' || CAST(trade_date AS VARCHAR) || '|42'", 10000)} AS b FROM trades)""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = X.random_split(views.trades(spark, sf_dir), ["symbol", "trade_date"])
    return split.select("symbol", "trade_date", "split")


@query("random_split_exact", BARS + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN rn <= n - ceil(n / 5.0) THEN 'train'
  WHEN rn <= n - ceil(ceil(n / 5.0) / 2) THEN 'test' ELSE 'validation' END AS split
FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (
  ORDER BY md5(symbol || '|' || CAST(trade_date AS VARCHAR) || '|42')) AS rn FROM trades)""")
def random_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = X.random_split_exact(views.trades(spark, sf_dir), ["symbol", "trade_date"])
    return split.select("symbol", "trade_date", "split")


SEQUENCES = Q.with_views(Q.TRADES) + """, numbered AS (SELECT *,
  row_number() OVER w - 61 AS seq_no, count(*) OVER (PARTITION BY symbol) - 60 AS n,
  list("close") OVER b AS closes, list(volume) OVER b AS volumes
  FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY trade_date),
  b AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
"""


@query("sequence_windows", SEQUENCES + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, seq_no, len(closes) AS length, closes[1] AS oldest_close,
  closes[60] AS newest_close, round(list_sum(list_transform(closes, lambda x, i: x * i)), 2) AS weighted_close,
  CAST(list_sum(list_transform(volumes, lambda x, i: x * i)) AS BIGINT) AS weighted_volume,
  "close" AS target_close, volume AS target_volume FROM numbered WHERE seq_no >= 0""")
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = X.sequence_windows(views.trades(spark, sf_dir))

    # One pass over the sequence gives both sums, weighted by position.
    start = F.struct(F.lit(0.0).alias("close"), F.lit(0).cast("long").alias("volume"), F.lit(1).alias("at"))
    sums = F.aggregate("sequence", start, lambda t, s: F.struct(
        (t["close"] + s["close"] * t["at"]).alias("close"), (t["volume"] + s["volume"] * t["at"]).alias("volume"),
        (t["at"] + 1).alias("at"),
    ))
    first, last = F.col("sequence")[0]["close"], F.col("sequence")[59]["close"]
    return windows.select(
        "symbol", "trade_date", "seq_no", F.size("sequence").alias("length"), first.alias("oldest_close"),
        last.alias("newest_close"), "target_close", "target_volume", sums.alias("_sums"),
    ).select(
        "*", F.round("_sums.close", 2).alias("weighted_close"), F.col("_sums.volume").alias("weighted_volume")
    ).drop("_sums")


@query("chrono_split", SEQUENCES + """
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, seq_no,
  CASE WHEN seq_no < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM numbered WHERE seq_no >= 0""")
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chrono_split(X.sequence_windows(views.trades(spark, sf_dir))).select(
        "symbol", "trade_date", "seq_no", "split"
    )


@query("last_row", BARS + f"""
SELECT {BAR_TEXT} FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1""")
def last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.last_row(views.trades(spark, sf_dir))
