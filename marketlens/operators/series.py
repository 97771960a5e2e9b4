"""Daily series: flatten nested documents, set bad rows aside, type and clean the bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import values as V
from marketlens.operators.ranked import keep_first
from marketlens.schemas import BAR_FIELDS, META_KEY, PRICES, SERIES_KEY

BAR_VALUES = [*PRICES, "volume"]


def gate_documents(docs: DataFrame, required: str = META_KEY) -> tuple[DataFrame, DataFrame]:
    """Split documents into those with the required key and those without."""
    present = F.col(f"`{required}`").isNotNull()
    return docs.where(present), docs.where(~present)


def filter_start_date(docs: DataFrame, start: str = "2023-05-01") -> DataFrame:
    """Keep only the days of each document from `start` on (ISO text compares as dates do)."""
    return docs.withColumn(SERIES_KEY, F.map_filter(F.col(f"`{SERIES_KEY}`"), lambda day, _: day >= start))


def flatten_series(docs: DataFrame) -> DataFrame:
    """One row per symbol and day, with the values as the text they arrived in."""
    days = docs.select("symbol", F.explode(F.col(f"`{SERIES_KEY}`")).alias("date", "day"))
    return days.select("symbol", "date", *[F.col("day")[field].alias(c) for c, field in BAR_FIELDS.items()])


def flatten_gated(docs: DataFrame, required: str = META_KEY) -> DataFrame:
    """`flatten_series` of the documents with the required key, and of each other one a row without a date, marked `gated`."""
    gated = F.col(f"`{required}`").isNull()
    found = F.explode_outer(F.when(~gated, F.col(f"`{SERIES_KEY}`"))).alias("date", "day")
    days = docs.select("symbol", gated.alias("gated"), found).where(F.col("gated") | F.col("date").isNotNull())
    return days.select("symbol", "gated", "date", *[F.col("day")[field].alias(c) for c, field in BAR_FIELDS.items()])


def _any(flags: Sequence[Column]) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`withColumns`, for parsed values that later steps use several times.

    Filters and projections are not moved below a generator. Without it each use repeats the parsing, and the
    generated method grows beyond what the JVM compiles.
    """
    inner = {c: f"_computed_{i}" for i, c in enumerate(columns)}
    values = F.inline(F.array(F.struct(*[value.alias(inner[c]) for c, value in columns.items()])))
    names = [*df.columns, *[c for c in columns if c not in df.columns]]
    return df.select("*", values).select(*[F.col(inner[c]).alias(c) if c in inner else F.col(f"`{c}`") for c in names])


def split_bad_numbers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed bars, and the raw rows holding a value that is present but not a number.

    Missing, null and NaN values become NULL. Both results are lazy; each reads the
    input with its own filter.
    """
    bad = _any([V.is_bad_number(F.col(c)) for c in BAR_VALUES])
    flagged = _computed(raw, {"_bad": bad})
    good = _computed(flagged.where(~F.col("_bad")).drop("_bad"), {c: V.to_number(F.col(c)) for c in BAR_VALUES})
    return good, flagged.where("_bad").drop("_bad").withColumn("bad_columns", _bad_columns())


def _bad_columns() -> Column:
    return F.concat_ws(",", *[F.when(V.is_bad_number(F.col(c)), F.lit(c)) for c in BAR_VALUES])


def judge_numbers(raw: DataFrame) -> DataFrame:
    """`split_bad_numbers` without the split: each row with its typed values (`<column>_number`) and its bad columns, if any."""
    return _computed(raw, {"bad_columns": _bad_columns(), **{f"{c}_number": V.to_number(F.col(c)) for c in BAR_VALUES}})


def split_fractional_volume(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose volume is whole or missing, and those where it is not."""
    fractional = V.is_fractional(F.col("volume"))
    return records.where(~fractional), records.where(fractional)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double where it is a number, NULL elsewhere; no row is dropped."""
    return _computed(df, {c: V.to_number(F.col(c).cast("string")) for c in columns}) if columns else df


def type_records(records: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Rename date, parse it, and type the volume. A bad date keeps its row with a NULL date. `more` names columns that stay."""
    return records.select(
        "symbol",
        V.to_date(F.col("date")).alias("trade_date"),
        *[V.finite(F.col(c)).alias(c) for c in PRICES],
        V.to_volume(F.col("volume")).alias("volume"),
        *more,
    )


def drop_null_key(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.na.drop(subset=[key])


def dedup_trades(df: DataFrame) -> DataFrame:
    """Distinct on the seven bar columns. They are all the columns, so any survivor is the same."""
    return df.dropDuplicates(["symbol", "trade_date", *BAR_VALUES])


def clean_trades(records: DataFrame) -> DataFrame:
    """Typed records ready for the trades table."""
    whole, _ = split_fractional_volume(records)
    return dedup_trades(drop_null_key(type_records(whole)))


def dedup_bar_first(bars: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One bar per symbol and day: the first by `order` (all values by default)."""
    return keep_first(bars, ["symbol", "trade_date"], [F.asc_nulls_last(c) for c in order or BAR_VALUES])


def filter_as_of(bars: DataFrame, as_of: str) -> DataFrame:
    """Bars up to the day before `as_of`."""
    return bars.where(F.col("trade_date") <= F.date_sub(F.lit(as_of).cast("date"), 1))


def filter_symbol(bars: DataFrame, symbol: str) -> DataFrame:
    return bars.where(F.col("symbol") == symbol)


def sort_bars(bars: DataFrame) -> DataFrame:
    return bars.orderBy("symbol", "trade_date", *BAR_VALUES)


def distinct_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def profile_counts(df: DataFrame) -> DataFrame:
    """Non-null count of every column and the row count, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("non_null")) for c in df.columns]
    return one.select(F.inline(F.array(*pairs)), F.col("_rows").alias("row_count"))


def drop_sparse_columns(df: DataFrame, min_share: float = 0.2, keep: Sequence[str] | None = None) -> DataFrame:
    """Drop columns with too few values, then rows with any NULL.

    The result's columns depend on the data, so this runs one counting job and reads
    its single row. Name the columns in `keep` to stay lazy.
    """
    if keep is None:
        counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
        sizes = counted.first().asDict()
        keep = [c for c in df.columns if sizes[c] >= min_share * sizes["_rows"]]
    return df.select(*keep).na.drop("any")


def clean_table(df: DataFrame, min_share: float = 0.2, keep: Sequence[str] | None = None) -> DataFrame:
    """Sparse columns out, incomplete rows out, full-row distinct."""
    return drop_sparse_columns(df, min_share, keep).distinct()


def coverage_report(bars: DataFrame, as_of: str, edge: int = 5) -> DataFrame:
    """Per symbol: first and last date, number of days, the first and last few dates, and whether `as_of` is there."""
    # The dates of a symbol are one set, no larger than the calendar.
    day, dates = F.col("trade_date"), F.array_sort("_dates")
    symbols = bars.groupBy("symbol").agg(
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        F.count(day).alias("bars"),
        F.max(day == F.lit(as_of).cast("date")).alias("has_as_of"),
        F.collect_set(day).alias("_dates"),
    )

    def joined(part: Column) -> Column:
        return F.when(F.col("last_date").isNotNull(), F.array_join(F.transform(part, lambda d: d.cast("string")), ","))

    return symbols.select(
        "symbol", "first_date", "last_date", "bars", "has_as_of",
        joined(F.slice(dates, 1, edge)).alias("first_dates"),
        joined(F.slice(dates, F.greatest(F.size("_dates") - edge + 1, F.lit(1)), F.lit(edge))).alias("last_dates"),
    )


def select_features(df: DataFrame, always: Sequence[str] = ("symbol", "trade_date")) -> DataFrame:
    """Identity columns and the columns whose name marks them as a lag or a rolling mean."""
    picked = [c for c in df.columns if "lag" in c or "_7d_avg" in c]
    return df.select(*always, *picked)


def rows_to_json(df: DataFrame, column: str = "payload") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)
