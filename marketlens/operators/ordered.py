"""Row numbers over a whole table, without a task that sees all of it.

A window without a key puts every row in one task. Here the rows are dealt by range of the order, so that each
task sorts its own stretch; the counts per stretch, one row a task, give the number at which each begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.scratch import staged

#: monotonically_increasing_id keeps the number of the task above these bits and the row's place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str | Column], column: str = "row_number", name: str = "numbered") -> DataFrame:
    """All rows and `column`: 0, 1, 2, ... along `order`, as a staged table.

    Rows that agree in the whole order are numbered in any way. They may be so many that one range would hold
    them all, so they are dealt by their place in the input. An empty table stays empty.
    """
    low, place = "_numbered_tie", "_numbered_place"
    keys = [*order, F.col(low)]
    spread = df.withColumn(low, F.xxhash64(F.monotonically_increasing_id()))
    sorted_rows = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(low)
    rows = staged(sorted_rows.withColumn(place, F.monotonically_increasing_id()), name)
    stretch = F.shiftrightunsigned(place, _PLACE_BITS)
    sizes = rows.groupBy(stretch.alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row a task: as many as the shuffle has partitions, whatever the table holds.
    return (
        rows.withColumn("_stretch", stretch)
        .join(F.broadcast(starts), "_stretch")
        .withColumn(column, F.col("_start") + F.col(place).bitwiseAND((1 << _PLACE_BITS) - 1))
        .drop("_stretch", "_start", place)
    )
