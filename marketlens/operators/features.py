"""Lag, rolling, scaling, split and sequence features of daily bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.values import hash_bucket
from marketlens.operators.ranked import top_k
from marketlens.operators.tiles import TILE_ROWS, cut
from marketlens.schemas import PRICES

BAR_VALUES = [*PRICES, "volume"]
ROLLED = ["close", "volume"]
NOT_FEATURES = ["symbol", "trade_date", "close", "volume"]


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Model inputs: everything but the identity and the two targets."""
    return [c for c in columns if c not in NOT_FEATURES]


def scaled_columns(columns: Sequence[str]) -> list[str]:
    """Columns that are standardised: lags and rolling means."""
    return [c for c in columns if "lag" in c or "_7d_avg" in c]


def _full_mean(name: str, frame, width: int) -> Column:
    # A mean only counts once the frame holds `width` values.
    return F.when(F.count(name).over(frame) == width, F.avg(name).over(frame))


def rolling_means(bars: DataFrame, columns: Sequence[str] = ROLLED, width: int = 7,
                  tile_rows: int = TILE_ROWS) -> DataFrame:
    """Trailing mean per symbol; NULL until `width` values are there."""
    tiles = cut(bars, width - 1, ties=BAR_VALUES, tile_rows=tile_rows)
    frame = tiles.window.rowsBetween(-(width - 1), 0)
    return tiles.finish(tiles.rows.withColumns(
        {f"{c}_{width}d_avg": _full_mean(c, frame, width) for c in columns}
    ))


def lag_features(bars: DataFrame, lags: int = 5, width: int = 7, complete: bool = True,
                 tile_rows: int = TILE_ROWS) -> DataFrame:
    """Lags 1..n of every bar value and trailing means of close and volume, per symbol by date.

    All window columns share one shuffle, one sort and one window pass over bounded
    tiles. With `complete`, rows with any NULL (the first rows of a series) are dropped.
    """
    tiles = cut(bars, max(lags, width - 1), ties=BAR_VALUES, tile_rows=tile_rows)
    frame = tiles.window.rowsBetween(-(width - 1), 0)
    lagged = {
        f"{c}_lag_{k}": F.lag(c, k).over(tiles.window) for k in range(1, lags + 1) for c in BAR_VALUES
    }
    rolled = {f"{c}_{width}d_avg": _full_mean(c, frame, width) for c in ROLLED}
    out = tiles.finish(tiles.rows.withColumns({**lagged, **rolled}))
    return out.na.drop("any") if complete else out


def _moments(columns: Sequence[str]) -> list[Column]:
    return [m for c in columns for m in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of some columns: one row."""
    return df.agg(*_moments(columns))


def as_value(one_row: DataFrame) -> Column:
    """A one-row frame as a struct value (a scalar subquery)."""
    return one_row.select(F.struct("*").alias("v")).scalar()


def z_score(value: Column, mean: Column, spread: Column) -> Column:
    """(x - mean) / spread; a constant column becomes 0."""
    return (value - mean) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def standardize(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None,
                by: str | None = None, moments: DataFrame | None = None) -> DataFrame:
    """Standardise columns with the moments of all rows, or of those where `fit_on` holds.

    Without `by` the moments are one scalar subquery (`moments` passes stored ones); with `by`
    they are joined per group.
    """
    source = df.where(fit_on) if fit_on is not None else df
    if by is None:
        fitted = moments if moments is not None else column_moments(source, columns)
        base, pick = df.withColumn("_fit", as_value(fitted)), lambda name: F.col("_fit").getField(name)
    else:
        base, pick = df.join(source.groupBy(by).agg(*_moments(columns)), by, "left"), F.col
    scaled = {c: z_score(F.col(c), pick(f"mean_{c}"), pick(f"std_{c}")) for c in columns}
    return base.withColumns(scaled).select(*df.columns)


def minmax_stats(df: DataFrame, columns: Sequence[str], by: str = "symbol") -> DataFrame:
    """Per-group minimum and maximum of some columns: one small row per group."""
    return df.groupBy(by).agg(
        *[s for c in columns for s in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    )


def unit_scale(value: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); a constant column becomes 0."""
    spread = (high - low).cast("double")
    return (value - low) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def unit_scale_back(value: Column, low: Column, high: Column) -> Column:
    return value * (high - low) + low


def minmax_scale(df: DataFrame, columns: Sequence[str], by: str = "symbol",
                 stats: DataFrame | None = None) -> DataFrame:
    """Scale columns to [0, 1] per group, by a join with the group statistics.

    The join stays an ordinary one: Spark broadcasts the statistics if they are small
    and otherwise splits the partitions of a hot group.
    """
    fitted = stats if stats is not None else minmax_stats(df, columns, by)
    scaled = {c: unit_scale(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}")) for c in columns}
    return df.join(fitted, by).withColumns(scaled).select(*df.columns)


def minmax_inverse(df: DataFrame, columns: Sequence[str], stats: DataFrame, by: str = "symbol") -> DataFrame:
    """Undo `minmax_scale` with the same statistics."""
    restored = {c: unit_scale_back(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}")) for c in columns}
    return df.join(stats, by).withColumns(restored).select(*df.columns)


def random_split(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """80/10/10 split label from a hash of the keys: no shuffle, and the same after a retry."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    draw = hash_bucket(key, 10000)
    label = F.when(draw < 8000, "train").when(draw < 9000, "test").otherwise("validation")
    return df.withColumn("split", label)


def random_split_exact(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Split of exact sizes: ceil(n/5) rows are held out, half of them (rounded up) for validation.

    Rows are ordered by a hash. Counts per hash prefix (65,536 at most) say in which
    prefix each border falls; rows of other prefixes are labelled from the counts
    alone, and only the two border prefixes are ranked. The keys should be unique.
    """
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    drawn = df.withColumn("_draw", F.md5(key)).withColumn("_prefix", F.substring("_draw", 1, 4))
    counts = drawn.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("_n").over(everything)
    held = F.ceil(total / 5)
    spans = counts.select(
        "_prefix",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
        "_n",
        (total - held).alias("_train_end"),
        (total - F.ceil(held / 2)).alias("_test_end"),
    )

    def label(position: Column) -> Column:
        return (F.when(position < F.col("_train_end"), "train")
                .when(position < F.col("_test_end"), "test").otherwise("validation"))

    # spans has at most 65,536 rows whatever the data, so that it can be broadcast.
    joined = drawn.join(F.broadcast(spans), "_prefix").withColumn(
        "split",
        F.when(label(F.col("_before")) == label(F.col("_before") + F.col("_n") - 1), label(F.col("_before"))),
    )
    settled = joined.where(F.col("split").isNotNull())
    inside = Window.partitionBy("_prefix").orderBy("_draw", *keys)
    border = joined.where(F.col("split").isNull()).withColumn(
        "split", label(F.col("_before") + F.row_number().over(inside) - 1)
    )
    return settled.select(*df.columns, "split").unionByName(border.select(*df.columns, "split"))


def sequence_windows(bars: DataFrame, length: int = 60, columns: Sequence[str] = ("close", "volume"),
                     tile_rows: int = TILE_ROWS) -> DataFrame:
    """Sliding windows of `length` rows with the next row as target, per symbol.

    Output: symbol, trade_date (of the target), seq_no, seq_count (of the symbol), sequence
    (array of structs), target_*.
    """
    tiles = cut(bars, length, ties=BAR_VALUES, tile_rows=tile_rows)
    back = tiles.window.rowsBetween(-length, -1)
    rows = tiles.rows.select(
        "symbol", "trade_date", "_own",
        (tiles.position - length).alias("seq_no"),
        (tiles.total - length).alias("seq_count"),
        F.collect_list(F.struct(*columns)).over(back).alias("sequence"),
        *[F.col(c).alias(f"target_{c}") for c in columns],
    )
    return rows.where(F.col("_own") & (F.col("seq_no") >= 0)).drop("_own")


def chrono_split(sequences: DataFrame, train_share: float = 0.8) -> DataFrame:
    """First int(share * n) sequences of a symbol train, the rest test. No shuffle: each row knows n."""
    trains = F.col("seq_no") < F.floor(F.col("seq_count") * F.lit(train_share))
    return sequences.withColumn("split", F.when(trains, "train").otherwise("test"))


def last_row(df: DataFrame, by: str = "symbol", order: str = "trade_date") -> DataFrame:
    """The newest row of each group; among rows of that date, the greatest by all columns.

    Each task keeps one row per group before the shuffle. Rows without a group or a date are left out.
    """
    known = df.where(F.col(by).isNotNull() & F.col(order).isNotNull())
    return top_k(known, [by], [F.desc(order), *[F.desc_nulls_last(c) for c in df.columns]], 1)


def last_sequence(bars: DataFrame, length: int = 60, columns: Sequence[str] = ("close", "volume"),
                  offset: int = 0) -> DataFrame:
    """The newest `length` rows of each symbol as one sequence; symbols with fewer rows are left out.

    `offset` leaves out that many of the newest rows.
    """
    newest_first = [F.desc("trade_date"), *[F.desc(c) for c in BAR_VALUES]]
    kept = top_k(bars.where(F.col("trade_date").isNotNull()), ["symbol"], newest_first, length + offset, rank="_age")
    return (
        kept.groupBy("symbol")
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("_age") > offset, F.struct((-F.col("_age")).alias("age"), *columns)))
            ).alias("items"),
            F.max("trade_date").alias("last_date"),
        )
        .where(F.size("items") == length)
        .select(
            "symbol", "last_date",
            F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in columns])).alias("sequence"),
        )
    )
