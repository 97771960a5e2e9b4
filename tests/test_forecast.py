import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import features as X
from marketlens.operators import forecast as M
from marketlens.operators.reservoir import Reservoir
from marketlens.plans import jobs
from tests_support import make_bars

AS_OF = "2001-06-01"


@pytest.fixture(scope="module")
def bars(spark):
    return make_bars(spark, {"a": 120, "b": 90, "c": 75}, gaps=False).cache()


@pytest.fixture(scope="module")
def forecasts(bars):
    small = {"rf": {"trees": 3, "depth": 3}, "gbt": {"rounds": 2, "depth": 3}, "seq_a": {}, "seq_b": {"units": 6}}
    return {name: df.collect() for name, df in jobs.forecast_trades(bars, AS_OF, small).items()}


def test_every_model_gives_five_days_per_symbol(forecasts):
    first = datetime.date.fromisoformat(AS_OF)
    for name, rows in forecasts.items():
        start = first if name in ("rf", "gbt") else first + datetime.timedelta(days=1)
        days = [start + datetime.timedelta(days=i) for i in range(5)]
        assert {(r["symbol"], r["trade_date"]) for r in rows} == {(s, d) for s in "abc" for d in days}, name
        assert len(rows) == 15
        assert all(math.isfinite(r["close_prediction"]) and math.isfinite(r["volume_prediction"]) for r in rows)


def test_tree_predictions_stay_in_range(forecasts, bars):
    low, high = bars.agg(F.min("close"), F.max("close")).first()
    assert all(low <= r["close_prediction"] <= high for r in forecasts["rf"])
    # The same feature row is used for each day.
    assert all(len({r["close_prediction"] for r in forecasts["rf"] if r["symbol"] == s}) == 1 for s in "abc")


def test_bars_after_the_day_before_are_not_used(bars):
    features = X.lag_features(bars)
    as_of = "2000-03-01"
    rows = M.forecast_flat(features, features, as_of, trees=2, depth=2).collect()
    assert min(r["trade_date"] for r in rows) == datetime.date(2000, 3, 1)


def test_business_days(spark):
    one = spark.range(1)
    for as_of in ("2024-06-07", "2024-06-08", "2024-06-09", "2024-06-10", "2024-06-12"):
        day, wanted = datetime.date.fromisoformat(as_of) - datetime.timedelta(days=1), []
        while len(wanted) < 7:
            day += datetime.timedelta(days=1)
            wanted += [day] if day.weekday() < 5 else []
        found = M.future_dates(one, as_of, 7, business_days=True).orderBy("day_no").collect()
        assert [r["trade_date"] for r in found] == wanted, as_of


def test_dates_after_the_last_bar(spark):
    df = spark.createDataFrame([("a", datetime.date(2024, 1, 5)), ("b", datetime.date(2023, 1, 5))], "symbol string, last_date date")
    found = {(r["symbol"], r["day_no"]): str(r["trade_date"]) for r in M.future_dates_after(df, "2024-01-03").collect()}
    assert found["a", 1] == "2024-01-06" and found["b", 1] == "2024-01-04" and found["b", 5] == "2024-01-08" and len(found) == 10


def test_models_per_symbol_are_limited(spark, bars):
    features = X.lag_features(bars)
    inputs = X.feature_columns(features.columns)
    fitted = M.fit_each(features.where("symbol <> 'c'"), inputs, trees=2, depth=2)
    assert sorted(fitted) == ["a", "b"]
    with pytest.raises(ValueError, match="more than 2"):
        M.fit_each(features, inputs, max_groups=2)


def test_unknown_symbol_takes_the_overall_mean(spark, bars):
    features = X.lag_features(bars)
    fitted = M.fit_pooled(features.where("symbol <> 'c'"), X.feature_columns(features.columns), trees=2, depth=2)
    rows = fitted.predict(fitted.prepare(X.last_row(features))).collect()
    assert {r["symbol"] for r in rows} == {"a", "b", "c"} and all(math.isfinite(r["close_hat"]) for r in rows)


def test_errors_in_original_units(bars):
    scores = jobs.score_trades(bars, {"seq_a": {}, "seq_b": {}}).collect()
    assert {(r["model"], r["symbol"]) for r in scores} == {(m, s) for m in ("seq_a", "seq_b") for s in "abc"}
    assert {r["symbol"] for r in scores} == {"a", "b", "c"} and all(0 < r["mse_close"] < 200 for r in scores)


def test_reservoir_state_is_the_recurrence(spark):
    network = Reservoir(units=5, seed=3)
    rng = random.Random(1)
    sequence = [(rng.random(), rng.random()) for _ in range(30)] + [(None, 0.5)]
    df = spark.createDataFrame([(sequence,), ([],)], "sequence array<struct<close: double, volume: double>>")
    wanted = [0.0] * 5
    for close, volume in sequence:
        wanted = [
            math.tanh(w["close"] * (close or 0) + w["volume"] * (volume or 0) + w["bias"] + w["own"] * wanted[i] + w["first"] * wanted[w["one"]] + w["second"] * wanted[w["two"]])
            for i, w in enumerate(network.weights)
        ]
    full, empty = (r["s"] for r in df.select(network.state(F.col("sequence")).alias("s")).collect())
    assert full == pytest.approx(wanted) and empty == [0.0] * 5
    assert Reservoir(units=5, seed=3).weights == network.weights != Reservoir(units=5, seed=4).weights


def test_sequence_models_beat_the_mean_where_there_is_something_to_learn(spark):
    rng, rows = random.Random(7), []
    for symbol, step in (("slow", 0.12), ("fast", 0.6), ("mid", 0.3)):
        for i in range(420):
            wave = 50 + 20 * math.sin(step * i) + rng.gauss(0, 1)
            rows.append((symbol, datetime.date(2000, 1, 1) + datetime.timedelta(days=i), wave, wave + 1, wave - 1, wave, int(1000 + 300 * math.cos(step * i) + rng.gauss(0, 9))))
    waves = spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume long")
    scores = jobs.score_trades(waves, {"seq_a": {}, "seq_b": {}}).collect()
    assert len(scores) == 6
    for r in scores:
        assert r["mse_close"] < 0.2 * r["mean_mse_close"] and r["mse_volume"] < 0.2 * r["mean_mse_volume"], r


def test_sequence_state_stays_in_the_jvm(bars):
    windows = X.sequence_windows(bars)
    plan = windows.select(Reservoir().encode(F.col("sequence")))._jdf.queryExecution().executedPlan().toString()
    assert "aggregate" in plan and "Python" not in plan


def test_boosted_trees_are_registered_with_full_settings(spark, sf_dir, monkeypatch):
    from marketlens.plans import forecast_queries

    asked = {}
    monkeypatch.setattr(forecast_queries.jobs, "forecast_trades", lambda bars, as_of, models: asked.update(models) or {"gbt": bars.selectExpr("1.0 AS volume_prediction", "1.0 AS close_prediction")})
    forecast_queries.forecast_gbt(spark, sf_dir)
    fitted = M.boosted_trees("close", **asked["gbt"])
    assert (fitted.getMaxIter(), fitted.getMaxDepth()) == (100, 6)


def test_batches_of_sequences_have_the_states_of_single_ones(spark, monkeypatch):
    from marketlens.operators import reservoir

    monkeypatch.setattr(reservoir, "CHUNK", 4)
    network, rng = Reservoir(units=5, seed=3), random.Random(2)
    rows = [([(rng.random(), rng.random()) for _ in range(n)],) for n in (7, 0, 3, 7, 7, 12)]
    rows += [([(None, 0.5), None, (0.25, None)],), (None,)]
    df = spark.createDataFrame(rows, "sequence array<struct<close: double, volume: double>>").coalesce(1)
    pairs = df.where("sequence IS NULL OR size(sequence) > 0").select(
        network.encode(F.col("sequence")).alias("one"), network.encode_batches(F.col("sequence")).alias("many")).collect()
    assert len(pairs) == 7 and all(r["many"] == (r["one"] and pytest.approx(r["one"])) for r in pairs)
    assert df.where("size(sequence) = 0").select(network.encode_batches(F.col("sequence")).alias("s")).first()["s"] == [0.0] * 7


def test_models_are_fitted_on_batches_of_windows(bars):
    fitted = M.fit_sequences(X.sequence_windows(bars), "reservoir", units=4)
    plan = fitted.encode(F.col("sequence"))
    explained = X.sequence_windows(bars).select(plan)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in explained and "aggregate(" not in explained


def test_series_give_the_models_and_errors_of_their_tables_of_windows(spark, bars):
    from marketlens.operators import series, sliding

    first = series.dedup_bar_first(bars)
    limits = M.bar_limits(first)
    windows = X.chrono_split(X.sequence_windows(M.scaled_bars(first, limits))).persist()
    train, test = (windows.where(F.col("split") == s) for s in ("train", "test"))
    rows = sliding.bar_series(first).persist()
    slid = [sliding.Windows(rows, train=t) for t in (True, False)]
    assert rows.count() == first.select("symbol").distinct().count()  # nothing is repeated once per window
    for kind in ("linear", "reservoir"):
        table, here = M.fit_sequences(train, kind), M.fit_sequences(slid[0], kind)
        scores = [{r["symbol"]: r for r in M.score_sequences(f, t, limits).collect()} for f, t in ((table, test), (here, slid[1]))]
        assert scores[0].keys() == scores[1].keys() and scores[0]
        for symbol, r in scores[0].items():
            assert [scores[1][symbol][c] for c in ("mse_close", "mse_volume")] == pytest.approx([r["mse_close"], r["mse_volume"]], rel=1e-6)
        days = [
            {(r["symbol"], r["trade_date"]): (r["volume_prediction"], r["close_prediction"]) for r in M.forecast_sequences(f, last, limits, "2001-01-01").collect()}
            for f, last in ((table, X.last_sequence(M.scaled_bars(first, limits))), (here, sliding.last_windows(rows)))
        ]
        assert days[0].keys() == days[1].keys() and all(days[1][k] == pytest.approx(v, rel=1e-6) for k, v in days[0].items())
    means = [{r["symbol"]: r for r in f.collect()} for f in (M.error_of_means(train, test, limits), M.error_of_means(*slid, limits))]
    assert means[0].keys() == means[1].keys()
    assert all(means[1][s]["mean_mse_close"] == pytest.approx(r["mean_mse_close"], rel=1e-6) for s, r in means[0].items())


def test_models_read_series_and_not_tables_of_windows(spark, bars, monkeypatch):
    monkeypatch.setattr(X, "sequence_windows", lambda *a, **k: pytest.fail("a table of windows"))
    assert jobs.score_trades(bars, {"seq_a": {}, "seq_b": {}}).count() == 6
    assert jobs.forecast_trades(bars, "2001-01-01", {"seq_a": {}, "seq_b": {}})["seq_b"].count() == 15


def test_missing_values_fail_a_training(spark):
    from marketlens.operators import sliding

    days = [datetime.date(2000, 1, 1) + datetime.timedelta(days=i) for i in range(80)]
    holed = spark.createDataFrame([("a", d, None if i == 65 else float(i % 7), i) for i, d in enumerate(days)], "symbol string, trade_date date, close double, volume long")
    with pytest.raises(Exception, match="missing"):
        M.fit_sequences(sliding.Windows(sliding.bar_series(holed), train=True))
    short = sliding.bar_series(holed.where("trade_date < '2000-02-10'"))
    with pytest.raises(ValueError, match="no training windows"):
        M.fit_sequences(sliding.Windows(short, train=True))
    assert sliding.last_windows(short).isEmpty()


def test_fits_run_on_methods_that_the_jvm_compiles(spark, bars, monkeypatch):
    from marketlens.sources import scratch

    seen, before = [], spark.conf.get(scratch.METHOD_LIMIT)

    class Recorder:
        def fit(self, rows):
            plan = rows._jdf.queryExecution().withCachedData().toString()
            seen.append((rows.sparkSession.conf.get(scratch.METHOD_LIMIT), rows.storageLevel.useMemory, "InMemoryRelation" in plan))

    monkeypatch.setitem(M.ESTIMATORS, "rf", lambda target, **settings: Recorder())
    features = X.lag_features(bars)
    M.fit_pooled(features, X.feature_columns(features.columns))
    assert seen == [("8000", False, True)] * 2 and spark.conf.get(scratch.METHOD_LIMIT) == before


def test_features_and_newest_rows_are_written_under_that_limit(spark, bars, monkeypatch):
    from marketlens.sources import scratch

    limits, stage = {}, scratch.staged

    def staged(df, name, *more):
        limits[name] = df.sparkSession.conf.get(scratch.METHOD_LIMIT)
        return stage(df, name, *more)

    monkeypatch.setattr(M, "staged", staged)
    monkeypatch.setattr(jobs, "staged", staged)
    jobs.forecast_trades(bars, AS_OF, {"rf": {"trees": 1, "depth": 1}})
    assert {limits[name] for name in ("features", "moments", "last-rows")} == {"8000"}
