"""Keep-first, top-k and keyed distinct that hold up when one key has a large share of the rows.

`row_number() <= k` is planned with a per-task limit before the shuffle, so a hot
key sends at most k rows per task to the task that makes the final choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The k first rows of each key in the given order; `rank` names an output column for the position."""
    position = rank or "_position"
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.where(F.col(position) <= k)
    return kept if rank else kept.drop(position)


def row_digest(*columns: str | Column) -> Column:
    """Fixed-width digest of some columns, NULLs included: a short stand-in for long text keys."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    record = F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return F.unhex(F.sha2(record, 256))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], long_keys: bool = False) -> DataFrame:
    """First row per key in a stated order. The order should be total, or the survivor is arbitrary.

    With `long_keys` (texts) rows are grouped by a digest of the key.
    """
    if not long_keys:
        return top_k(df, keys, order, 1)
    return top_k(df.withColumn("_key", row_digest(*keys)), ["_key"], order, 1).drop("_key")


def latest_distinct(df: DataFrame, by: Sequence[str], date: str, columns: Sequence[str], k: int,
                    newest: bool = True, rank: str | None = None) -> DataFrame:
    """Per key, the k newest (or oldest) rows of DISTINCT (date, columns)."""
    slim = df.select(*by, date, *columns).distinct()
    first = F.desc_nulls_last(date) if newest else F.asc_nulls_last(date)
    return top_k(slim, by, [first, *[F.asc_nulls_last(c) for c in columns]], k, rank)
