"""Plain-text questions: symbol, field, horizon, route, and the data rows that answer them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.containment import containing_texts
from marketlens.operators.ranked import latest_distinct, top_k
from marketlens.sources.scratch import staged

# Company names in order of precedence.
STOCK_NAMES = {
    "microsoft": "MSFT",
    "apple": "AAPL",
    "netflix": "NFLX",
    "nvidia": "NVDA",
    "amazon": "AMZN",
}
# Field phrases in order of precedence.
FIELD_PHRASES = {
    "closing price": "close",
    "volume": "volume",
    "highest price": "high",
    "lowest price": "low",
    "opening price": "open",
}
# Horizon phrases in order of precedence, and the horizon without one.
HORIZON_PHRASES = [("1 day", 1), ("tomorrow", 1), ("3 days", 3)]
DEFAULT_HORIZON = 5
# Caption formats.
AHEAD_CAPTION = "Predictions for %s (Next %d Days)"
MODEL_CAPTION = " using %s"
BACK_CAPTION = "%s for %s (Last %d Days)"


def _first_match(text: Column, choices: Sequence[tuple[str, object]]) -> Column:
    """Value of the first phrase a text contains; a CASE over `contains`, NULL if none does."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(phrase), F.lit(value)) for phrase, value in choices])


def question_symbol(text: Column, names: Mapping[str, str] = STOCK_NAMES) -> Column:
    return _first_match(text, list(names.items()))


def question_field(text: Column) -> Column:
    return _first_match(text, list(FIELD_PHRASES.items()))


def question_horizon(text: Column) -> Column:
    return F.coalesce(_first_match(text, HORIZON_PHRASES), F.lit(DEFAULT_HORIZON))


def match_symbols(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Symbol per question from a name table (name, symbol, priority) of any size.

    The name found in the text with the lowest priority wins. Uses the exact
    containment join, so neither table is broadcast by request.
    """
    needles = names.select(F.lower("name").alias("needle")).distinct().withColumn("needle_id", F.md5("needle"))
    asked = questions.select("qid", F.lower("text").alias("text")).withColumn("text_id", F.md5("text"))
    texts = staged(asked.select("text_id", "text").distinct(), "texts")
    pairs = containing_texts(staged(needles, "needles"), texts, digest_ids=True)
    ranked = names.select(F.md5(F.lower("name")).alias("needle_id"), "symbol", "priority")
    best = (
        pairs.join(ranked, "needle_id").groupBy("text_id")
        .agg(F.min_by("symbol", F.struct("priority", "symbol")).alias("symbol"))
    )
    found = asked.select("qid", "text_id").join(best, "text_id", "left").drop("text_id")
    return questions.join(found, "qid", "left")


def route_questions(questions: DataFrame, names: Mapping[str, str] = STOCK_NAMES, model: str | None = None) -> DataFrame:
    """Add symbol, field, days, route (prediction / history / free_text) and a caption to questions(qid, text).

    With `model` a prediction's caption names the model that is asked.
    """
    text = F.col("text")
    routed = questions.withColumns({
        "symbol": question_symbol(text, names),
        "field": question_field(text),
        "days": question_horizon(text),
    })
    forward = F.lower(text).contains("predict") & F.col("symbol").isNotNull()
    backward = F.col("symbol").isNotNull() & F.col("field").isNotNull()
    routed = routed.withColumn(
        "route", F.when(forward, "prediction").when(backward, "history").otherwise("free_text")
    )
    ahead = F.format_string(AHEAD_CAPTION, F.upper("symbol"), F.col("days"))
    if model is not None:
        ahead = F.concat(ahead, F.format_string(MODEL_CAPTION, F.lit(model)))
    back = F.format_string(BACK_CAPTION, F.initcap("field"), F.upper("symbol"), F.col("days"))
    return routed.withColumn(
        "caption", F.when(F.col("route") == "prediction", ahead).when(F.col("route") == "history", back)
    )


def topk_latest(bars: DataFrame, symbol: str, field: str, k: int = 5) -> DataFrame:
    """The k newest distinct (date, value) rows of one symbol."""
    rows = bars.where(F.col("symbol") == symbol).select("trade_date", field).distinct()
    return rows.orderBy(F.desc_nulls_last("trade_date"), F.asc_nulls_last(field)).limit(k)


PREDICTED = ["volume_prediction", "close_prediction"]


def topk_predictions(predictions: DataFrame, symbol: str, k: int = 5, model: str | None = None,
                     from_date: str | None = None) -> DataFrame:
    """The k earliest distinct stored predictions of one symbol; `from_date` leaves older ones out."""
    rows = predictions.where(F.col("symbol") == symbol)
    if model is not None:
        rows = rows.where(F.col("model") == model)
    if from_date is not None:
        rows = rows.where(F.col("trade_date") >= F.lit(from_date).cast("date"))
    first = [F.asc_nulls_last(c) for c in ["trade_date", *PREDICTED]]
    return rows.select("trade_date", *PREDICTED).distinct().orderBy(*first).limit(k)


def _most_days(asked: DataFrame) -> int:
    """The longest horizon of any question."""
    return asked.agg(F.max("days")).first()[0] or 0


def answer_history(routed: DataFrame, bars: DataFrame) -> DataFrame:
    """Newest rows of the asked field for every history question.

    Bars are first cut to the few rows any question can ask for: per symbol the
    newest dates (a missing one last), then per symbol and field the newest distinct values. Questions
    join that, so neither a hot symbol's bars nor its questions multiply.
    """
    fields = list(FIELD_PHRASES.values())
    asked = staged(routed.where(F.col("route") == "history").select("qid", "symbol", "field", "days"), "history-questions")
    most = _most_days(asked)
    dates = bars.select(F.col("symbol").alias("_symbol"), F.col("trade_date").alias("_date")).distinct()
    days = top_k(dates, ["_symbol"], [F.desc_nulls_last("_date")], most)
    same = (F.col("symbol") == F.col("_symbol")) & F.col("trade_date").eqNullSafe(F.col("_date"))
    recent = bars.join(days, same, "left_semi")
    long = recent.select(
        "symbol", "trade_date",
        F.inline(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields
        ])),
    )
    newest = latest_distinct(long, ["symbol", "field"], "trade_date", ["value"], most, rank="nth")
    return (
        asked.join(newest, ["symbol", "field"])
        .where(F.col("nth") <= F.col("days"))
        .select("qid", "symbol", "field", "nth", "trade_date", "value")
    )


def answer_prediction(routed: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """Earliest stored predictions of one model for every prediction question; a partitioned table is pruned by model."""
    chosen = predictions.where(F.col("model") == model)
    asked = routed.where(F.col("route") == "prediction").select("qid", "symbol", "days")
    earliest = latest_distinct(chosen, ["symbol"], "trade_date", PREDICTED, _most_days(asked), newest=False, rank="nth")
    return (
        asked.join(earliest, "symbol")
        .where(F.col("nth") <= F.col("days"))
        .select("qid", "symbol", "nth", "trade_date", *PREDICTED)
    )
