import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import features as X
from marketlens.operators import forecast as M
from marketlens.operators import forests
from marketlens.plans import forecast_queries
from tests_support import make_bars


def _score(target, weights, left):
    return sum((weights[s] * target[s]).sum() ** 2 / weights[s].sum() for s in (left, ~left))


def _check(tree, node, inputs, target, weights):
    """The best of all borders at every inner node; leaves hold one value, or rows that no input tells apart. Returns the depth."""
    assert tree.value[node] == pytest.approx(np.average(target, weights=weights))
    sides = [inputs[:, f] <= v for f in range(inputs.shape[1]) for v in np.unique(inputs[:, f])[:-1]]
    f = tree.feature[node]
    if f < 0:
        assert len(set(target)) == 1 or not sides
        return 0
    left = inputs[:, f] <= tree.border[node]
    assert left.any() and not left.all()
    assert _score(target, weights, left) == pytest.approx(max(_score(target, weights, s) for s in sides))
    return 1 + max(_check(tree, child, inputs[s], target[s], weights[s]) for child, s in ((tree.left[node], left), (tree.right[node], ~left)))


@pytest.mark.parametrize("kinds", [4, 1000])
def test_trees_are_full_and_every_split_is_the_best(kinds):
    draw = np.random.default_rng(kinds)
    inputs, target = draw.integers(0, kinds, (60, 3)).astype(float), draw.normal(size=60).round(1)
    weights = np.stack([np.bincount(draw.integers(0, 60, 60), minlength=60) for _ in range(7)])
    grown = forests.grow(forests.Ranked(inputs), target, weights)
    depths = [_check(grown, t, inputs[w > 0], target[w > 0], w[w > 0]) for t, w in enumerate(weights)]
    assert max(depths) > 5
    found = grown.predict(inputs)
    for i, row in enumerate(inputs):
        for t in range(7):
            at = t
            while grown.feature[at] >= 0:
                at = grown.left[at] if row[grown.feature[at]] <= grown.border[at] else grown.right[at]
            assert found[i, t] == grown.value[at]
    shallow = forests.grow(forests.Ranked(inputs), target, weights, depth=2)
    assert max(_depth(shallow, t) for t in range(7)) == 2
    assert (forests.grow(forests.Ranked(inputs), np.ones(60), weights).feature == -1).all()


def _depth(tree, node):
    return 0 if tree.feature[node] < 0 else 1 + max(_depth(tree, tree.left[node]), _depth(tree, tree.right[node]))


def test_forecasts_use_a_hundred_full_trees_per_symbol(spark, sf_dir, monkeypatch):
    asked, pooled = [], []
    forecast = forests.forecast_newest
    monkeypatch.setattr(forests, "forecast_newest", lambda *a, **k: asked.append(k) or forecast(*a, **{**k, "trees": 2}))
    monkeypatch.setattr(M, "fit_pooled", lambda *a, **k: pooled.append((a, k)) or pytest.fail("a pooled forest"))
    assert forecast_queries.forecast_rf(spark, sf_dir).count() == 50
    assert asked == [{}] and not pooled
    assert forecast.__defaults__[:2] == (100, None)  # trees, depth
    assert (M.random_forest("close").getNumTrees(), M.random_forest("close").getMaxDepth()) == (100, 30)


def test_every_model_of_forecast_days_has_its_full_settings(spark, sf_dir, monkeypatch):
    asked = []

    def forecast_trades(bars, as_of, models=None):
        asked.append(models)
        return {"rf": bars.selectExpr("symbol", "trade_date", "1.0 AS volume_prediction", "1.0 AS close_prediction")}

    monkeypatch.setattr(forecast_queries.jobs, "forecast_trades", forecast_trades)
    forecast_queries.forecast_days(spark, sf_dir)
    assert all(models is None or not any(models.values()) and set(models) == {"rf", "gbt", "seq_a", "seq_b"} for models in asked) and asked


def test_forests_are_the_same_however_rows_are_dealt(spark):
    features = X.lag_features(make_bars(spark, {"a": 60, "b": 40, "c": 30}, gaps=False)).persist()
    known = features.where("symbol <> 'c'")
    runs = [
        {r["symbol"]: r for r in M.forecast_flat(train, features, "2001-06-01", days=1, trees=5).collect()}
        for train in (known, known.repartition(7, F.rand(3)))
    ]
    assert runs[0] == runs[1] and set(runs[0]) == {"a", "b", "c"}
    means = known.groupBy("symbol").agg(F.avg("close").alias("m")).agg(F.avg("m")).first()[0]
    assert runs[0]["c"]["close_prediction"] == pytest.approx(means)  # no training rows
    assert runs[0]["a"]["trade_date"] == datetime.date(2001, 6, 1)
    low, high = known.where("symbol = 'a'").agg(F.min("close"), F.max("close")).first()
    assert low <= runs[0]["a"]["close_prediction"] <= high


def test_missing_values_fail_a_forest(spark):
    features = X.lag_features(make_bars(spark, {"a": 30}, gaps=False))
    with pytest.raises(Exception, match="missing value"):
        M.forecast_flat(features.withColumn("open", F.when(F.col("open") > 4, F.col("open"))), features, "2001-06-01", trees=1).collect()


def test_rows_of_forests_are_dealt_before_they_are_scaled(spark, monkeypatch):
    from marketlens.plans import jobs

    seen, stage = {}, jobs.staged
    monkeypatch.setattr(jobs, "staged", lambda df, name, *more: seen.update({name: more}) or stage(df, name, *more))
    monkeypatch.setattr(M, "forecast_flat", lambda train, newest, as_of, **settings: seen.update(train=train, newest=newest))
    jobs.forecast_trades(make_bars(spark, {"a": 30, "b": 20}, gaps=False), "2001-06-01", {"rf": {}})
    above, below = seen["train"]._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [symbol")
    assert "_fit" in above and "_fit" not in below and seen["features"] == ("zstd",)
    assert seen["train"].exceptAll(seen["newest"]).isEmpty() and not seen["train"].isEmpty()
