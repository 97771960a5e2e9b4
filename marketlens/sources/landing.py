"""Landing-zone readers. Schemas are declared, so that reading never needs an inference pass."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas as S

CORRUPT = "_corrupt"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


# How the landing files of one symbol are named.
SERIES_NAME = r"filtered_([^/]+)_data\.json"
NEWS_NAME = r"news_([^/]+)_data\.json"
FILINGS_NAME = r"raw_([^/]+)_10k\.json"


def _named(pattern: str) -> Column:
    """First group of `pattern` in the path of a row's file; NULL where it does not match."""
    return F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit(""))


def symbol_from_name(df: DataFrame, pattern: str, column: str = "symbol") -> DataFrame:
    """Add the entity named in each row's file path (first group of `pattern`)."""
    return df.withColumn(column, _named(pattern))


def _json(spark: SparkSession, path: str, schema: T.StructType, lines: bool) -> DataFrame:
    """One document per file, or one per line. Large landings should use lines: those files can be split."""
    return spark.read.schema(schema).option("multiLine", str(not lines)).json(path)


SERIES_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), *S.SERIES_DOC.fields])


def series_symbol(name_pattern: str | None = None) -> Column:
    """Symbol of a daily-series document.

    It is the one in the file's name if a pattern is given; else the document's own `symbol`, else the symbol
    in its meta data, else the one in a name like `filtered_X_data.json`.
    """
    own = [F.col("symbol"), F.col(f"`{S.META_KEY}`")[S.META_SYMBOL]]
    return F.coalesce(_named(name_pattern), *own) if name_pattern else F.coalesce(*own, _named(SERIES_NAME))


def read_series(spark: SparkSession, path: str, lines: bool = False, name_pattern: str | None = None) -> DataFrame:
    """Daily-series documents with their symbol (see `series_symbol`)."""
    return _json(spark, path, SERIES_SCHEMA, lines).withColumn("symbol", series_symbol(name_pattern))


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Flat bar records, as JSON arrays or lines."""
    return _json(spark, path, S.BAR_RECORD, lines)


def _news_texts(spark: SparkSession, path: str, lines: bool, name_pattern: str | None) -> tuple[DataFrame, list[str]]:
    texts = spark.read.text(path, wholetext=not lines)
    if name_pattern is None:
        return texts.select("value", *feed_place()), []
    return symbol_from_name(texts, name_pattern, "feed_symbol").select("feed_symbol", "value", *feed_place()), ["feed_symbol"]


@contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """While a table of many folders is opened: some folders a task. Spark would start a task per folder, up to 10,000."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def feed_place() -> list[Column]:
    """File, start of the block and a rising number, which together sort the lines of a feed.

    The number only rises inside a task, and a task reads a block from front to back, so that the order is the same
    whatever the blocks are dealt to.
    """
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line")]


def _feed_items(texts: DataFrame, names: list[str], items: Column) -> DataFrame:
    """Items with their place in their array and a key that sorts them over all files of the feed."""
    found = texts.select(*names, "file", "block", "line", F.posexplode(items).alias("feed_pos", "item"))
    return found.select(*names, "feed_pos", F.struct("file", "block", "line", "feed_pos").alias("feed_order"), "item")


def read_news(spark: SparkSession, path: str, lines: bool = False, name_pattern: str | None = None) -> DataFrame:
    """Feed items with their position: a JSON array per file (or per line), or one item per line.

    `feed_pos` is the place in an array, `feed_order` the place in the whole feed: files by path, then lines, then items.
    """
    texts, names = _news_texts(spark, path, lines, name_pattern)
    items = F.from_json("value", T.ArrayType(S.NEWS_ITEM))
    return _feed_items(texts, names, items).select(*names, "feed_pos", "feed_order", "item.*")


def variant_items(texts: DataFrame, names: list[str]) -> DataFrame:
    """Items, as variants, of texts(value, file, block, line) that hold an array of items or one item."""
    record = F.try_parse_json("value")
    many = F.try_variant_get(record, "$", "array<variant>")
    return _feed_items(texts, names, F.coalesce(many, F.when(record.isNotNull(), F.array(record))))


def read_news_variant(spark: SparkSession, path: str, lines: bool = False,
                      name_pattern: str | None = None) -> DataFrame:
    """As `read_news`, with each item as a variant, which tells a missing key from a JSON null."""
    return variant_items(*_news_texts(spark, path, lines, name_pattern))


def read_filings(spark: SparkSession, path: str, lines: bool = False,
                 name_pattern: str = FILINGS_NAME) -> tuple[DataFrame, DataFrame]:
    """Filings documents with the symbol in their file's name, and (file, text) of what could not be read as one.

    An unreadable document is set aside; a file that vanishes while it is being read is skipped.
    """
    schema = T.StructType([
        T.StructField("company_name", T.StringType()), *S.FILINGS_DOC.fields, T.StructField(CORRUPT, T.StringType()),
    ])
    texts = spark.read.option("ignoreMissingFiles", "true").text(path, wholetext=not lines)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    docs = texts.select(F.col("_metadata.file_path").alias("file"), _named(name_pattern).alias("symbol"), parsed.alias("doc"))
    unreadable = F.col(f"doc.{CORRUPT}").isNotNull()
    return (
        docs.where(~unreadable).select("symbol", "doc.*").drop(CORRUPT),
        docs.where(unreadable).select("file", F.col(f"doc.{CORRUPT}").alias("text")),
    )


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)


def latest_snapshot_path(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path (up to the end of the pattern) with the greatest timestamp captured by `pattern`.

    Files are only listed: the binary source is asked for the path column alone.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select(F.regexp_extract("path", f"^(.*{pattern})", 1).alias("snapshot"),
                F.try_to_timestamp(F.regexp_extract("path", pattern, 1), F.lit("yyyyMMddHHmmss")).alias("run_ts"))
        .where(F.col("run_ts").isNotNull())
    )
    newest = listed.agg(F.max(F.struct("run_ts", "snapshot")).alias("m")).first()["m"]
    if newest is None:
        raise FileNotFoundError(f"no file below {folder} matches {pattern}")
    return newest["snapshot"]


def read_latest_csv(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    return read_csv(spark, latest_snapshot_path(spark, folder, pattern), schema)


def latest_run_name(spark: SparkSession, path: str) -> str:
    """Greatest run_ts among the partitions of a snapshot table that hold a file. Files are only listed, none is opened."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        .select(F.nullif(F.regexp_extract("path", r"/run_ts=([^/]+)/", 1), F.lit("")).alias("run"))
    )
    newest = listed.agg(F.max("run")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no run below {path}")
    return newest


def read_latest_run(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Newest run of a snapshot table partitioned by run_ts (14 digits) and split; other runs are not opened."""
    newest = latest_run_name(spark, path)
    # The schema is that of the newest run, so that no footer of another run is read either.
    schema = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/run_ts={newest}").schema
    runs = spark.read.schema(schema).parquet(path)
    chosen = runs.where(F.col("run_ts") == F.lit(newest).cast(schema["run_ts"].dataType))
    return chosen.where(F.col("split") == split) if split else chosen


def run_query(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None) -> DataFrame | None:
    """Result of a query with named parameters, or None if it has no rows."""
    result = spark.sql(sql, args=dict(args or {}))
    return None if result.isEmpty() else result


def param_query(spark: SparkSession, sql: str, args: Mapping[str, object], **views: DataFrame) -> DataFrame:
    """Query over DataFrames named in the SQL text as {name}, with named markers (:name) for values."""
    return spark.sql(sql, args=dict(args), **views)
