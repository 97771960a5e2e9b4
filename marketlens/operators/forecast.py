"""Five-day forecasts: forests, boosted trees and sequence models, fitted over all symbols at once.

Forests are fitted per symbol with full trees, inside the tasks (`forests.py`). Of the other kinds one pooled model per target serves
all symbols, so that training is one distributed job whatever the number of symbols and however rows are spread over them. A symbol
enters as its mean targets, which splits symbols as a categorical feature would, at any number of
them. `fit_each` trains one model per symbol for a handful of symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.vectors import slide
from marketlens.operators import features as X
from marketlens.operators import forests, sliding
from marketlens.operators.reservoir import Reservoir
from marketlens.sources.scratch import compiled_methods, staged

TARGETS = ("volume", "close")
FORECAST_DAYS = 5


# --- dates and frames ----------------------------------------------------------

def _business_day(start: Column, number: Column) -> Column:
    """The number-th weekday after `start`."""
    # Weekdays count from Monday 0; a weekend start counts from its Friday.
    friday = F.date_sub(start, F.greatest(F.weekday(start) - 4, F.lit(0)))
    ahead = F.weekday(friday) + number
    return F.date_add(friday, (number + 2 * F.floor(ahead / 5)).cast("int"))


def future_dates(df: DataFrame, as_of: str, days: int = FORECAST_DAYS, business_days: bool = False) -> DataFrame:
    """Each row once per forecast day: the days after yesterday, counted from `as_of`."""
    yesterday = F.date_sub(F.lit(as_of).cast("date"), 1)
    numbered = df.withColumn("day_no", F.explode(F.sequence(F.lit(1), F.lit(days))))
    day = _business_day(yesterday, F.col("day_no")) if business_days else F.date_add(yesterday, F.col("day_no"))
    return numbered.withColumn("trade_date", day)


def future_dates_after(df: DataFrame, as_of: str, last: str = "last_date", days: int = FORECAST_DAYS) -> DataFrame:
    """Each row once per day after its last date or `as_of`, whichever is later."""
    start = F.date_add(F.greatest(F.col(last), F.lit(as_of).cast("date")), 1)
    dates = F.sequence(start, F.date_add(start, days - 1))
    return df.select("*", F.posexplode(dates).alias("_i", "trade_date")).withColumn(
        "day_no", F.col("_i") + 1
    ).drop("_i")


def forecast_frame(df: DataFrame, volume: str = "volume", close: str = "close") -> DataFrame:
    """Prediction table columns."""
    return df.select(
        "symbol", "trade_date",
        F.col(volume).cast("double").alias("volume_prediction"),
        F.col(close).cast("double").alias("close_prediction"),
    )


def union_forecasts(forecasts: dict[str, DataFrame]) -> DataFrame:
    """Forecasts of several models in one frame, with the model name."""
    named = [df.withColumn("model", F.lit(name)) for name, df in forecasts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def _one_row_per_day(df: DataFrame, steps: list[tuple[Column, Column]], dates: list[Column]) -> DataFrame:
    days = [
        F.struct(day.alias("trade_date"), v.alias("volume_prediction"), c.alias("close_prediction"))
        for day, (v, c) in zip(dates, steps)
    ]
    return df.select("symbol", F.inline(F.array(*days)))


# --- estimators ------------------------------------------------------------------

def random_forest(target: str, trees: int = 100, depth: int = 30, seed: int = 42, **more) -> Estimator:
    """A pooled forest, as deep as MLlib can grow one by default."""
    return RandomForestRegressor(
        featuresCol="features", labelCol=target, predictionCol=f"{target}_hat", numTrees=trees,
        maxDepth=depth, featureSubsetStrategy="all", seed=seed, **more,
    )


def boosted_trees(target: str, rounds: int = 100, depth: int = 6, step: float = 0.3, seed: int = 42, **more) -> Estimator:
    return GBTRegressor(
        featuresCol="features", labelCol=target, predictionCol=f"{target}_hat", maxIter=rounds,
        maxDepth=depth, stepSize=step, seed=seed, **more,
    )


def linear_model(target: str, ridge: float = 1e-4) -> Estimator:
    return LinearRegression(featuresCol="features", labelCol=target, predictionCol=f"{target}_hat", regParam=ridge)


ESTIMATORS = {"rf": random_forest, "gbt": boosted_trees, "linear": linear_model}


@dataclass
class Forecaster:
    """Fitted models for the targets, and the per-symbol means they take as inputs."""

    models: dict[str, Model | sliding.Readout]
    inputs: list[str]
    means: DataFrame | None
    encode: Callable[[Column], Column] | None = None
    slide_over: sliding.Encoder | None = None

    def prepare(self, rows: DataFrame) -> DataFrame:
        """Add the symbol's means. A symbol without training rows takes the mean over symbols."""
        if self.means is None:
            return rows
        names = [c for c in self.means.columns if c != "symbol"]
        overall = X.as_value(self.means.agg(*[F.avg(c).alias(c) for c in names]))
        joined = rows.join(self.means, "symbol", "left").withColumn("_overall", overall)
        return joined.withColumns({c: F.coalesce(F.col(c), F.col("_overall")[c]) for c in names}).drop("_overall")

    def assemble(self, rows: DataFrame) -> DataFrame:
        names = [] if self.means is None else [c for c in self.means.columns if c != "symbol"]
        return VectorAssembler(inputCols=[*self.inputs, *names], outputCol="features").transform(rows)

    def predict(self, prepared: DataFrame) -> DataFrame:
        """Add `<target>_hat` columns to prepared rows."""
        out = self.assemble(prepared)
        for model in self.models.values():
            out = model.transform(out)
        return out.drop("features")


def _fit_targets(rows: DataFrame, kind: str, targets: Sequence[str], settings: dict) -> dict[str, Model]:
    """Fit the targets side by side on the same stored rows: their small jobs fill each other's gaps.

    Trees read the rows a few times only and then keep points of their own, for which the memory is left.
    """
    with compiled_methods(rows.sparkSession):  # what is stored is planned here
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK if kind == "linear" else StorageLevel.DISK_ONLY)

    def fit(target: str) -> Model:
        return ESTIMATORS[kind](target, **settings).fit(rows)

    try:
        with compiled_methods(rows.sparkSession), ThreadPoolExecutor(len(targets)) as pool:
            return dict(zip(targets, pool.map(inheritable_thread_target(rows.sparkSession)(fit), targets)))
    finally:
        rows.unpersist()


def _symbol_means(train: DataFrame, targets: Sequence[str]) -> DataFrame:
    return staged(train.groupBy("symbol").agg(*[F.avg(t).alias(f"symbol_{t}") for t in targets]), "means")


def fit_pooled(train: DataFrame, inputs: Sequence[str], kind: str = "rf", targets: Sequence[str] = TARGETS,
               pooled: bool = True, **settings) -> Forecaster:
    """Fit one model per target over all rows; both read the same stored training vectors.

    Training reads `train` several times: pass a stored table.
    """
    means = None
    if pooled:
        means = _symbol_means(train, targets)
    out = Forecaster({}, list(inputs), means)
    labels = [F.col(t).cast("double").alias(t) for t in targets]
    out.models = _fit_targets(out.assemble(out.prepare(train)).select("features", *labels), kind, targets, settings)
    return out


# --- forests: the same prediction for each day -------------------------------------

def forecast_flat(train: DataFrame, newest: DataFrame, as_of: str, kind: str = "rf", days: int = FORECAST_DAYS,
                  business_days: bool = False, pooled: bool = False, **settings) -> DataFrame:
    """Predict once from the newest feature row of each symbol and repeat it for each day.

    `rf` fits a forest of full trees per symbol; a symbol without training rows takes the mean over symbols. `pooled`, and every other
    kind, fits one model over all of them.
    """
    inputs, known = X.feature_columns(train.columns), _known(train, as_of)
    if kind == "rf" and not pooled:
        predicted = _forests_per_symbol(known, _last_rows(newest, as_of), inputs, settings)
    else:
        fitted = fit_pooled(known, inputs, kind, **settings)
        predicted = fitted.predict(fitted.prepare(_last_rows(newest, as_of))).drop("trade_date")
    dated = future_dates(predicted, as_of, days, business_days)
    return forecast_frame(dated, "volume_hat", "close_hat")


def _forests_per_symbol(train: DataFrame, newest: DataFrame, inputs: Sequence[str], settings: dict) -> DataFrame:
    means = _symbol_means(train, TARGETS)
    overall = X.as_value(means.agg(*[F.avg(f"symbol_{t}").alias(t) for t in TARGETS]))
    with compiled_methods(train.sparkSession):
        found = staged(forests.forecast_newest(train, newest, inputs, TARGETS, **settings), "forests")
    filled = {f"{t}_hat": F.coalesce(F.col(f"{t}_hat"), F.col("_overall")[t]) for t in TARGETS}
    return found.withColumn("_overall", overall).withColumns(filled).drop("_overall")


def _known(df: DataFrame, as_of: str) -> DataFrame:
    return df.where(F.col("trade_date") <= F.date_sub(F.lit(as_of).cast("date"), 1))


def _last_rows(newest: DataFrame, as_of: str) -> DataFrame:
    with compiled_methods(newest.sparkSession):
        return staged(X.last_row(_known(newest, as_of)), "last-rows")


# --- boosted trees: predictions fed back ---------------------------------------------

def forecast_recursive(train: DataFrame, newest: DataFrame, moments: DataFrame, as_of: str, kind: str = "gbt",
                       days: int = FORECAST_DAYS, **settings) -> DataFrame:
    """Predict day by day, feeding each prediction into the two rolling-mean inputs.

    `train` and `newest` hold features standardised with `moments`. A prediction is standardised
    with them too, then scaled per symbol as the inputs are.
    """
    inputs = X.feature_columns(train.columns)
    known = _known(train, as_of)
    with compiled_methods(train.sparkSession):
        limits = staged(X.minmax_stats(known, inputs), "limits")
    scaled = X.minmax_scale(known, inputs, stats=limits)
    fitted = fit_pooled(scaled, inputs, kind, **settings)

    fed = {"close": "close_7d_avg", "volume": "volume_7d_avg"}
    rows = (
        fitted.prepare(_last_rows(newest, as_of)).join(limits, "symbol")
        .withColumns({c: X.unit_scale(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}")) for c in inputs})
        .withColumn("_level", X.as_value(moments))
    )

    def as_input(target: str, prediction: Column) -> Column:
        c = fed[target]
        standard = X.z_score(prediction, F.col("_level")[f"mean_{c}"], F.col("_level")[f"std_{c}"])
        return X.unit_scale(standard, F.col(f"min_{c}"), F.col(f"max_{c}"))

    steps = []
    for day in range(1, days + 1):
        rows = fitted.predict(rows)
        rows = rows.withColumnsRenamed({f"{t}_hat": f"{t}_{day}" for t in TARGETS})
        rows = rows.withColumns({fed[t]: as_input(t, F.col(f"{t}_{day}")) for t in TARGETS})
        steps.append((F.col(f"volume_{day}"), F.col(f"close_{day}")))
    yesterday = F.date_sub(F.lit(as_of).cast("date"), 1)
    return _one_row_per_day(rows, steps, [F.date_add(yesterday, d) for d in range(1, days + 1)])


# --- per-symbol models, for a handful of symbols ----------------------------------------

def fit_each(train: DataFrame, inputs: Sequence[str], kind: str = "rf", max_groups: int = 5,
             **settings) -> dict[str, Forecaster]:
    """One forecaster per symbol; more than `max_groups` symbols is an error, use the pooled form."""
    found = [r[0] for r in train.select("symbol").distinct().limit(max_groups + 1).collect()]
    if len(found) > max_groups:
        raise ValueError(f"more than {max_groups} symbols: fit a pooled model")
    return {
        s: fit_pooled(train.where(F.col("symbol") == s), inputs, kind, pooled=False, **settings)
        for s in sorted(found)
    }


# --- sequence models ----------------------------------------------------------------------

def _numbers_of(sequence: Column) -> Column:
    return F.flatten(F.transform(sequence, lambda s: F.array(s["close"], s["volume"])))


def _flat(sequence: Column) -> Column:
    return array_to_vector(_numbers_of(sequence))


def _typed(bars: DataFrame) -> DataFrame:
    return bars.withColumn("volume", F.col("volume").cast("double"))


def bar_limits(bars: DataFrame) -> DataFrame:
    """Minimum and maximum of close and volume per symbol."""
    return X.minmax_stats(_typed(bars), ["close", "volume"])


def scaled_bars(bars: DataFrame, limits: DataFrame) -> DataFrame:
    """Bars with close and volume scaled to [0, 1] per symbol."""
    return X.minmax_scale(_typed(bars), ["close", "volume"], stats=limits)


def _fit_slid(train: sliding.Windows, kind: str, ridge: float = 1e-4, **settings) -> Forecaster:
    if kind == "reservoir":
        network = Reservoir(**settings)
        slide_over, encode = network.slid(train.length), network.encode_batches
    elif kind == "linear" and not settings:
        slide_over, encode = sliding.flat(train.length), _numbers_of
    else:
        raise ValueError(f"{kind} with {sorted(settings)} needs a table of windows")
    return Forecaster(sliding.fit_readouts(train, slide_over, TARGETS, ridge), ["sequence"], None, encode, slide_over)


def fit_sequences(train: DataFrame | sliding.Windows, kind: str = "linear", **settings) -> Forecaster:
    """Fit close and volume on windows(sequence, target_close, target_volume), or on the windows of a table of series, which are
    not written out: the same models up to rounding, for the linear kinds.

    `linear` and the tree kinds read the flattened window; `reservoir` reads it row by row with a recurrent
    state and fits a ridge regression on the last one. Its settings are those of `Reservoir`, and `ridge`.
    """
    if isinstance(train, sliding.Windows):
        return _fit_slid(train, kind, **settings)
    encode = _flat
    if kind == "reservoir":
        network = Reservoir(**{k: settings.pop(k) for k in list(settings) if k != "ridge"})
        kind, encode = "linear", lambda sequence: array_to_vector(network.encode_batches(sequence))
    rows = train.select(
        encode(F.col("sequence")).alias("features"),
        F.col("target_close").alias("close"), F.col("target_volume").alias("volume"),
    )
    return Forecaster(_fit_targets(rows, kind, TARGETS, settings), ["sequence"], None, encode)


def predict_sequences(fitted: Forecaster, windows: DataFrame) -> DataFrame:
    out = windows.withColumn("features", fitted.encode(F.col("sequence")))
    for model in fitted.models.values():
        out = model.transform(out)
    return out.drop("features")


def forecast_sequences(fitted: Forecaster, last: DataFrame, limits: DataFrame, as_of: str,
                       days: int = FORECAST_DAYS) -> DataFrame:
    """Slide each symbol's last window over its own predictions, and scale them back.

    The window is one bounded array per symbol; the five steps are columns of one plan. A model fitted on windows that were slid inside
    the tasks also takes its steps there, in one pass over a batch.
    """
    rows = last
    if fitted.slide_over is not None:
        rows = sliding.slide_forward(last, fitted.slide_over, fitted.models, days)
    for day in range(1, days + 1) if fitted.slide_over is None else ():
        rows = predict_sequences(fitted, rows).withColumnsRenamed({f"{t}_hat": f"{t}_{day}" for t in TARGETS})
        item = F.struct(F.col(f"close_{day}").alias("close"), F.col(f"volume_{day}").alias("volume"))
        rows = rows.withColumn("sequence", slide(F.col("sequence"), item))
    rows = rows.join(limits, "symbol")

    def back(target: str, day: int) -> Column:
        return X.unit_scale_back(F.col(f"{target}_{day}"), F.col(f"min_{target}"), F.col(f"max_{target}"))

    steps = [(back("volume", d), back("close", d)) for d in range(1, days + 1)]
    start = F.greatest(F.col("last_date"), F.lit(as_of).cast("date"))
    return _one_row_per_day(rows, steps, [F.date_add(start, d) for d in range(1, days + 1)])


def mse_by_symbol(scored: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean squared error per symbol: `pairs` maps an output name to its actual and predicted columns."""
    return scored.groupBy("symbol").agg(
        *[F.avg(F.pow(F.col(a) - F.col(p), 2)).alias(name) for name, (a, p) in pairs.items()]
    )


def _in_units(rows: DataFrame, limits: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """`columns` maps a new name to a scaled column and its target."""
    joined = rows.join(limits, "symbol")
    return joined.withColumns({
        name: X.unit_scale_back(F.col(source), F.col(f"min_{t}"), F.col(f"max_{t}")) for name, (source, t) in columns.items()
    })


def score_sequences(fitted: Forecaster, test: DataFrame | sliding.Windows, limits: DataFrame) -> DataFrame:
    """Error of test windows in original units, per symbol (rows for a model_metrics table)."""
    if isinstance(test, sliding.Windows):
        return sliding.readout_errors(test, fitted.slide_over, fitted.models)
    columns = {f"{p}_{t}": (source.format(t), t) for t in TARGETS for p, source in (("actual", "target_{}"), ("predicted", "{}_hat"))}
    restored = _in_units(predict_sequences(fitted, test), limits, columns)
    return mse_by_symbol(restored, {f"mse_{t}": (f"actual_{t}", f"predicted_{t}") for t in TARGETS})


def error_of_means(train: DataFrame | sliding.Windows, test: DataFrame | sliding.Windows, limits: DataFrame) -> DataFrame:
    """What a model is measured against: the error per symbol of its mean over the training windows, in original units."""
    if isinstance(test, sliding.Windows):
        return sliding.errors_of_means(test)
    means = train.groupBy("symbol").agg(*[F.avg(f"target_{t}").alias(f"mean_{t}") for t in TARGETS])
    columns = {f"{p}_{t}": (source.format(t), t) for t in TARGETS for p, source in (("actual", "target_{}"), ("guess", "mean_{}"))}
    return mse_by_symbol(_in_units(test.join(means, "symbol"), limits, columns), {f"mean_mse_{t}": (f"actual_{t}", f"guess_{t}") for t in TARGETS})
