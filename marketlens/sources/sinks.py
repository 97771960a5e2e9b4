"""File and table sinks, and guards in front of them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.sources.scratch import shuffles_removed, staged


def balanced(df: DataFrame, *by: str) -> DataFrame:
    """Group rows for a partitioned write. Spark splits the output of a hot value over several tasks."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def write_json(df: DataFrame, path: str, by: Sequence[str] = ("symbol",), compression: str | None = None) -> None:
    """JSON lines per partition; only the partitions present in `df` are replaced.

    While they are replaced both the old and the new files are there; `compression` (such as gzip) makes them smaller.
    """
    writer = balanced(df, *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    with shuffles_removed(df.sparkSession):
        writer.option("ignoreNullFields", "false").partitionBy(*by).json(path, compression=compression)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_snapshot(df: DataFrame, path: str, run_ts: str) -> None:
    """Add one run (14-digit timestamp) to a snapshot table partitioned by run_ts and the `split` column."""
    stamped = balanced(df.withColumn("run_ts", F.lit(run_ts)), "split")
    (stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_ts", "split").parquet(path))


def guard_dates(df: DataFrame, column: str = "trade_date") -> DataFrame:
    """Fail the job on a NULL date. The check is a filter, so that column pruning cannot remove it."""
    valid = F.assert_true(F.col(column).isNotNull(), F.lit(f"invalid date in {column}"))
    return df.where(valid.isNull())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema in its order, cast to its types. A missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def split_conforming(df: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that fit a schema (cast), and rows with a value that does not cast or a required one missing.

    A fraction does not fit a whole-number column.
    """
    bad = F.lit(False)
    for field in schema:
        raw = F.col(field.name)
        bad = bad | (raw.isNotNull() & raw.try_cast(field.dataType).isNull())
        if isinstance(field.dataType, T.IntegralType) and isinstance(df.schema[field.name].dataType, T.FractionalType):
            bad = bad | F.coalesce(raw != F.floor(raw), F.lit(False))
        if field.name in required:
            bad = bad | raw.isNull()
    fitted = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]
    return df.where(~bad).select(*fitted), df.where(bad)


def append_table(df: DataFrame, table: str, on_date: str | None = None) -> None:
    """Append rows to a catalog table, in its columns and types."""
    spark = df.sparkSession
    fitted = conform(guard_dates(df, on_date) if on_date else df, spark.table(table).schema)
    fitted.write.mode("append").insertInto(table)


def _range_of(df: DataFrame, column: str) -> Column:
    """A filter for the values from the least to the greatest of a column; NULL passes if the column holds one."""
    value = F.col(column)
    low, high, blanks = df.agg(F.min(value), F.max(value), F.count_if(value.isNull())).first()
    near = F.lit(False) if low is None else value.between(F.lit(low), F.lit(high))
    return near | value.isNull() if blanks else near


def append_new_rows(df: DataFrame, table: str, keys: Sequence[str], within: str | None = None) -> None:
    """Append the rows whose keys the table does not hold, so that a repeated run adds nothing.

    `within` names a key whose range in the new rows limits what is read of the table: a daily
    append then skips the partitions, or the row groups, of other days.
    """
    stored = df.sparkSession.table(table)
    fitted = conform(df, stored.schema)
    if within is not None:
        fitted = staged(fitted, "new-rows")
        stored = stored.where(_range_of(fitted, within))
    same = None
    for k in keys:
        match = fitted[k].eqNullSafe(stored[k])
        same = match if same is None else same & match
    _stage_and_insert(fitted.join(stored, same, "left_anti"), table, overwrite=False)


def insert_rows(df: DataFrame, table: str, required: Sequence[str] = (), on_error: str = "fail") -> DataFrame:
    """Append the rows that fit the table and return those that do not.

    With `on_error="fail"` any unfit row fails the call before anything is written; with
    "log" the fit rows are written and the others are only returned.
    """
    good, bad = split_conforming(df, df.sparkSession.table(table).schema, required)
    if on_error == "fail" and not bad.isEmpty():
        raise ValueError(f"rows do not fit {table}")
    good.write.mode("append").insertInto(table)
    return bad


@contextmanager
def _whole_table_overwrite(spark: SparkSession) -> Iterator[None]:
    # Inserts into a table follow the session's mode, which may be set to replace single partitions.
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "static")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _stage_and_insert(df: DataFrame, table: str, overwrite: bool) -> None:
    # A table cannot be overwritten while it is read, so the result is written aside first.
    with _whole_table_overwrite(df.sparkSession):
        staged(df, "stage").write.insertInto(table, overwrite=overwrite)


def replace_table(df: DataFrame, table: str, on_date: str | None = None) -> None:
    """Replace all rows of a table in one overwrite."""
    spark = df.sparkSession
    fitted = conform(guard_dates(df, on_date) if on_date else df, spark.table(table).schema)
    with _whole_table_overwrite(spark):
        fitted.write.insertInto(table, overwrite=True)


def replace_model(df: DataFrame, table: str, model: str) -> None:
    """Replace the predictions of one model, its partition of the table; other partitions stay."""
    if not re.fullmatch(r"[\w-]+", model):
        raise ValueError(f"not a model name: {model}")
    spark = df.sparkSession
    schema = T.StructType([f for f in spark.table(table).schema if f.name != "model"])
    fitted = conform(guard_dates(df), schema)
    spark.sql(f"INSERT OVERWRITE {table} PARTITION (model = '{model}') SELECT * FROM {{fitted}}", fitted=fitted)


def dedup_table(spark: SparkSession, table: str) -> None:
    """Replace a table by its distinct rows."""
    _stage_and_insert(spark.table(table).distinct(), table, overwrite=True)
