import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.operators import features as X
from marketlens.operators import tiles
from tests_support import make_bars


def expected_features(pdf):
    out = []
    for _, g in pdf.sort_values(["symbol", "trade_date"]).groupby("symbol"):
        g = g.copy()
        for k in range(1, 6):
            for c in X.BAR_VALUES:
                g[f"{c}_lag_{k}"] = g[c].shift(k)
        for c in X.ROLLED:
            g[f"{c}_7d_avg"] = g[c].rolling(7).mean()
        out.append(g)
    return pd.concat(out).dropna()


@pytest.mark.parametrize("tile_rows", [6, 7, 16, 4096])
def test_lags_match_pandas_at_any_tile_size(spark, tile_rows):
    bars = make_bars(spark, {"hot": 300, "a": 40, "b": 7, "c": 6, "d": 1})
    found = X.lag_features(bars, tile_rows=tile_rows).toPandas().sort_values(["symbol", "trade_date"])
    wanted = expected_features(bars.toPandas())
    assert list(found["symbol"]) == list(wanted["symbol"])
    for c in wanted.columns[2:]:
        assert (found[c].astype(float).round(9).to_numpy() == wanted[c].astype(float).round(9).to_numpy()).all(), c


def test_positions_and_tile_sizes_with_many_rows_per_day(spark):
    # Revisions: several rows per day, and days that are larger than a tile.
    rows = [("hot", datetime.date(2000, 1, 1) + datetime.timedelta(days=i // 400), float(i)) for i in range(2000)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, value double")
    cut = tiles.cut(bars, halo=20, ties=["value"], tile_rows=50)
    placed = cut.finish(cut.rows.withColumn("position", cut.position))
    assert placed.where(F.col("position") != F.col("value")).count() == 0 and placed.count() == 2000
    assert cut.rows.groupBy("_tile").count().agg(F.min("count"), F.max("count")).first()[:] == (50, 70)


def test_one_hot_day_is_cut_like_any_other(spark):
    day = F.lit("2000-01-03").cast("date")
    bars = spark.range(30000).select(F.lit("hot").alias("symbol"), day.alias("trade_date"), (F.col("id") % 7).alias("value"))
    cut = tiles.cut(bars, halo=60, ties=["value"])
    sizes = cut.rows.groupBy("_tile").agg(F.count("*").alias("n"), F.sum(F.col("_own").cast("int")).alias("own"))
    assert sizes.agg(F.max("n"), F.max("own"), F.sum("own")).first()[:] == (4096 + 60, 4096, 30000)
    assert cut.rows.where("_own").agg(F.countDistinct(cut.position)).first()[0] == 30000


def test_tiles_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    bars = make_bars(spark, {"a": 300, "b": 20}).coalesce(1).mapInPandas(count, "symbol string, trade_date date, open double, high double, low double, close double, volume long")
    X.lag_features(bars, tile_rows=64).collect()
    # Once for the bounds of the ranges, which Spark samples, and once for the rows.
    assert seen.value <= 2 * 320


def test_shuffled_input_gives_the_same_rows(spark):
    bars = make_bars(spark, {"a": 90, "b": 80})
    one = X.lag_features(bars, tile_rows=16)
    two = X.lag_features(bars.repartition(7).orderBy(F.rand(3)), tile_rows=32)
    assert one.exceptAll(two).count() == 0 and one.count() == two.count() == 84 + 74


def test_null_dates_have_no_place(spark):
    bars = make_bars(spark, {"a": 10}).unionByName(
        make_bars(spark, {"a": 1}).withColumn("trade_date", F.lit(None).cast("date")))
    assert X.lag_features(bars).count() == 4


def test_constant_columns_scale_to_zero(spark):
    bars = make_bars(spark, {"a": 8}).withColumn("close", F.lit(3.0))
    assert {r[0] for r in X.standardize(bars, ["close"]).select("close").collect()} == {0.0}
    assert {r[0] for r in X.minmax_scale(bars, ["close"]).select("close").collect()} == {0.0}


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 9.0)], "symbol string, x double")
    fitted = X.standardize(df, ["x"], fit_on=F.col("symbol") == "a").where("symbol = 'a'")
    assert [round(r["x"], 6) for r in fitted.orderBy("x").collect()] == [-1.224745, 0.0, 1.224745]
    by = X.standardize(df, ["x"], by="symbol")
    assert by.where("symbol = 'b'").first()["x"] == 0.0


def test_minmax_round_trip(spark):
    bars = make_bars(spark, {"a": 30, "b": 2})
    limits = X.minmax_stats(bars, ["close"])
    scaled = X.minmax_scale(bars, ["close"], stats=limits)
    assert scaled.agg(F.min("close"), F.max("close")).first()[:] == (0.0, 1.0)
    back = X.minmax_inverse(scaled, ["close"], limits).select("symbol", "trade_date", F.round("close", 6).alias("close"))
    assert back.exceptAll(bars.select("symbol", "trade_date", "close")).count() == 0


@pytest.mark.parametrize("n,sizes", [(1, (0, 0, 1)), (10, (8, 1, 1)), (11, (8, 1, 2)), (1234, (987, 123, 124))])
def test_exact_split_sizes(spark, n, sizes):
    split = X.random_split_exact(spark.range(n), ["id"])
    found = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert tuple(found.get(s, 0) for s in ("train", "test", "validation")) == sizes


def test_hash_split_is_stable(spark):
    one, two = (X.random_split(spark.range(1000).repartition(n), ["id"]) for n in (2, 5))
    assert one.exceptAll(two).count() == 0
    assert 760 < one.where("split = 'train'").count() < 840


def test_sequences_split_and_last_window(spark):
    bars = make_bars(spark, {"hot": 200, "a": 61, "b": 60})
    pdf = bars.toPandas().sort_values(["symbol", "trade_date"])
    windows = X.chrono_split(X.sequence_windows(bars, tile_rows=64)).collect()
    assert {s: sum(w["symbol"] == s for w in windows) for s in ("hot", "a", "b")} == {"hot": 140, "a": 1, "b": 0}
    closes = {s: list(g["close"]) for s, g in pdf.groupby("symbol")}
    for w in windows:
        i = w["seq_no"]
        assert [x["close"] for x in w["sequence"]] == closes[w["symbol"]][i:i + 60]
        assert w["target_close"] == closes[w["symbol"]][i + 60]
        assert w["split"] == ("train" if i < int(0.8 * (len(closes[w["symbol"]]) - 60)) else "test")
    for offset in (0, 1):
        last = {r["symbol"]: [x["close"] for x in r["sequence"]] for r in X.last_sequence(bars, offset=offset).collect()}
        assert set(last) == ({"hot", "a", "b"} if offset == 0 else {"hot", "a"})
        assert last["hot"] == closes["hot"][140 - offset:200 - offset]


def test_last_row_and_names(spark):
    bars = make_bars(spark, {"a": 20, "b": 5})
    wanted = bars.toPandas().sort_values("trade_date").groupby("symbol").tail(1)
    assert {(r["symbol"], r["close"]) for r in X.last_row(bars).collect()} == set(zip(wanted["symbol"], wanted["close"]))
    names = X.lag_features(bars).columns
    assert len(names) == 34 and len(X.scaled_columns(names)) == 27 and len(X.feature_columns(names)) == 30
