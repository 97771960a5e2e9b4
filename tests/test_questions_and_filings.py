import datetime

from pyspark.sql import functions as F

from marketlens.operators import filings, questions


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, text string")


def test_routes(spark):
    routed = questions.route_questions(ask(
        spark, "List each closing price of Microsoft, please.",
        "Show me your prediction about Microsoft.", "Who founded Netflix and when?",
        "Does weather matter to Amazon?", "NVIDIA Volume over 11 days",
        "apple and microsoft highest price tomorrow", "predict the market")).orderBy("qid").collect()
    assert [(r["symbol"], r["field"], r["days"], r["route"]) for r in routed] == [
        ("MSFT", "close", 5, "history"), ("MSFT", None, 5, "prediction"), ("NFLX", None, 5, "free_text"),
        ("AMZN", None, 5, "free_text"), ("NVDA", "volume", 1, "history"), ("MSFT", "high", 1, "history"),
        (None, None, 5, "free_text")]
    assert routed[0]["caption"] == "Close for MSFT (Last 5 Days)"
    named = questions.route_questions(ask(spark, "predict apple", "apple volume"), model="seq_a").orderBy("qid").collect()
    assert [r["caption"] for r in named] == ["Predictions for AAPL (Next 5 Days) using seq_a", "Volume for AAPL (Last 5 Days)"]
    assert routed[1]["caption"] == "Predictions for MSFT (Next 5 Days)" and routed[2]["caption"] is None


def bars(spark):
    start = datetime.date(2024, 1, 1)
    rows = [(s, start + datetime.timedelta(days=i), float(i), i) for s in ("MSFT", "AAPL") for i in range(9)]
    rows += [("MSFT", start + datetime.timedelta(days=8), 8.0, 8), ("MSFT", start + datetime.timedelta(days=8), 8.5, 8)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume long")
    return df.withColumns({c: F.col("close") for c in ("open", "high", "low")})


def test_history_answers_are_distinct_and_newest(spark):
    asked = questions.route_questions(ask(spark, "closing price of microsoft 3 days", "volume of microsoft 3 days", "predict apple"))
    found = questions.answer_history(asked, bars(spark)).orderBy("qid", "nth").collect()
    assert [(r["qid"], r["value"]) for r in found] == [(0, 8.0), (0, 8.5), (0, 7.0), (1, 8.0), (1, 7.0), (1, 6.0)]
    top = questions.topk_latest(bars(spark), "MSFT", "close", 2).collect()
    assert [r["close"] for r in top] == [8.0, 8.5]


def test_history_follows_the_questions_horizon_and_keeps_undated_bars(spark):
    asked = questions.route_questions(ask(spark, "closing price of apple")).withColumn("days", F.lit(20))
    undated = bars(spark).where("symbol = 'AAPL'").limit(1).withColumns({"trade_date": F.lit(None).cast("date"), "close": F.lit(-1.0)})
    found = questions.answer_history(asked, bars(spark).unionByName(undated)).orderBy("nth").collect()
    assert [r["value"] for r in found] == [8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0, -1.0]


def test_prediction_answers_take_the_earliest(spark):
    stored = bars(spark).select("symbol", "trade_date", F.col("close").alias("volume_prediction"),
                                F.col("close").alias("close_prediction"), F.lit("seq_a").alias("model"))
    stored = stored.unionByName(stored.withColumns({"model": F.lit("seq_b"), "close_prediction": F.lit(-1.0)}))
    asked = questions.route_questions(ask(spark, "predict apple tomorrow", "predict apple 3 days"))
    found = questions.answer_prediction(asked, stored, "seq_a").orderBy("qid", "nth").collect()
    assert [(r["qid"], r["close_prediction"]) for r in found] == [(0, 0.0), (1, 0.0), (1, 1.0), (1, 2.0)]
    top = questions.topk_predictions(stored, "AAPL", 2, "seq_a", from_date="2024-01-04").collect()
    assert [r["close_prediction"] for r in top] == [3.0, 4.0]


def test_many_names_give_the_same_symbols(spark):
    names = [("Apple", "AAPL", 2), ("pine apple", "PINE", 1), ("Micro soft", "MS", 3), ("x", "X", 9), ("apple", "A2", 5)]
    dim = spark.createDataFrame(names, "name string, symbol string, priority int")
    texts = ["a pine apple tree", "an APPLE a day", "micro soft", "boxes", "nothing here", ""]
    found = questions.match_symbols(ask(spark, *texts), dim).orderBy("qid").collect()
    wanted = [min(((p, s) for n, s, p in names if n.lower() in t.lower()), default=(0, None))[1] for t in texts]
    assert [r["symbol"] for r in found] == wanted


def documents(spark):
    doc = "struct<recent: struct<form: array<string>, filingDate: array<string>, primaryDocument: array<string>, primaryDocDescription: array<string>>>"
    return spark.createDataFrame([
        ("A", "320193", ((["10-K", "8-K", "4"], ["2024-01-01", None, "2024-01-03"], ["a.htm  b.htm", "", "c"], ["d1", "d2"]),)),
        ("B", "1", (None,)),
        ("C", "2", (([], [], [], []),)),
    ], f"company_name string, cik string, filings {doc}")


def test_uneven_arrays_stop_at_the_shortest(spark):
    rows = filings.flatten_filings(documents(spark)).collect()
    assert [(r["form_type"], r["filing_date"], r["document_links"], r["description"], r["content"]) for r in rows] == [
        ("10-K", "2024-01-01", ["a.htm", "b.htm"], "d1", None), ("8-K", None, [], "d2", None)]
    report = filings.uneven_filings(documents(spark)).collect()
    assert [(r["company_name"], r["entries_left_out"]) for r in report] == [("A", 1)]


def test_cik_lookup(spark):
    rows = spark.createDataFrame([("AAPL",), ("ZZZ",)], "symbol string")
    assert [tuple(r) for r in filings.lookup_cik(rows, filings.cik_frame(spark)).collect()] == [("AAPL", "0000320193")]
