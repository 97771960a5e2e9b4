import datetime

from pyspark.sql import functions as F

from marketlens import schemas as S
from marketlens.functions import values as V
from marketlens.operators import series

RAW = "symbol string, date string, open string, high string, low string, close string, volume string"


def raw(spark, **changes):
    row = {"symbol": "A", "date": "2024-01-02", "open": "1.5", "high": "2", "low": "1", "close": "1.25", "volume": "10"}
    return spark.createDataFrame([{**row, **changes}], RAW)


def test_bad_missing_and_spelled_out_numbers(spark):
    expected = {None: ("good", None), "abc": ("bad", None), "1_000": ("bad", None), "1.0d": ("bad", None),
                "NaN": ("good", None), "inf": ("good", None), " 2.50 ": ("good", 2.5), "-1e3": ("good", -1000.0),
                "": ("bad", None), ".5": ("good", 0.5)}
    for text, (side, value) in expected.items():
        good, bad = series.split_bad_numbers(raw(spark, open=text))
        assert (good.count(), bad.count()) == ((1, 0) if side == "good" else (0, 1)), text
        if side == "good":
            assert good.first()["open"] == value
        else:
            assert bad.first()["bad_columns"] == "open"


def test_volume_and_dates(spark):
    records = spark.createDataFrame(
        [("A", "2024-01-02", None), ("A", "2024-13-05", 3.0), ("A", "2024-01-04", 2.7), (None, "2024-01-05", 1.0)],
        "symbol string, date string, volume double",
    ).withColumns({c: F.lit(1.0) for c in S.PRICES})
    whole, fractional = series.split_fractional_volume(records)
    assert fractional.first()["date"] == "2024-01-04"
    found = {r["trade_date"]: r["volume"] for r in series.clean_trades(records).collect()}
    assert found == {datetime.date(2024, 1, 2): 0, None: 3}
    assert whole.count() == 3


def test_flatten_filters_days_and_skips_documents_without_meta(spark):
    day = {f: "1.0" for f in S.BAR_FIELDS.values()}
    docs = spark.createDataFrame(
        [("A", {"x": "y"}, {"2023-04-28": day, "2023-05-01": day}), ("B", None, {"2023-06-01": day})],
        f"symbol string, `{S.META_KEY}` map<string,string>, `{S.SERIES_KEY}` map<string,map<string,string>>",
    )
    valid, rejected = series.gate_documents(docs)
    rows = series.flatten_series(series.filter_start_date(valid)).collect()
    assert [(r["symbol"], r["date"]) for r in rows] == [("A", "2023-05-01")]
    assert [r["symbol"] for r in rejected.collect()] == ["B"]


def test_sparse_columns(spark):
    rows = [(i, i if i % 2 else None, 1 if i == 0 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    out = series.drop_sparse_columns(df)
    assert out.columns == ["a", "b"] and out.count() == 5
    assert series.drop_sparse_columns(df, keep=["a"]).count() == 10
    counts = {r["column_name"]: (r["non_null"], r["row_count"]) for r in series.profile_counts(df).collect()}
    assert counts == {"a": (10, 10), "b": (5, 10), "c": (1, 10)}


def test_coverage_keeps_few_dates(spark):
    bars = spark.range(20).select(
        F.lit("A").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date")
    )
    row = series.coverage_report(bars, "2024-01-20").first()
    assert row["bars"] == 20 and row["has_as_of"]
    assert row["first_dates"].split(",")[0] == "2024-01-01" and len(row["first_dates"].split(",")) == 5
    assert row["last_dates"].split(",")[-1] == "2024-01-20"


def test_first_bar_per_day_and_json(spark):
    bars = spark.createDataFrame(
        [("A", datetime.date(2024, 1, 1), 2.0), ("A", datetime.date(2024, 1, 1), 1.0)], "symbol string, trade_date date, open double"
    ).withColumns({c: F.lit(1.0) for c in ("high", "low", "close")}).withColumn("volume", F.lit(1).cast("long"))
    assert [r["open"] for r in series.dedup_bar_first(bars).collect()] == [1.0]
    assert series.rows_to_json(bars.select("symbol").limit(1)).first()[0] == '{"symbol":"A"}'
    assert series.preview(bars, 1).count() == 1


def test_variant_tells_missing_from_null(spark):
    df = spark.createDataFrame([('{"k": null}',), ("{}",), ('{"k": 1.5}',)], "t string").select(F.parse_json("t").alias("v"))
    assert [r[0] for r in df.select(V.variant_field(F.col("v"), "$.k", "double", 0.0)).collect()] == [None, 0.0, 1.5]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a\tb  c ", "320193", "20240131T0910")], "t string, c string, p string")
    row = df.select(V.split_words(F.col("t")), V.padded_id(F.col("c")), V.to_published(F.col("p"))).first()
    assert row[0] == ["a", "b", "c"] and row[1] == "0000320193" and row[2] is None


def test_values_are_parsed_once_per_row(spark):
    raw = spark.createDataFrame([("a", "2024-01-01", *["1.5"] * 4, "7")], "symbol string, date string, open string, high string, low string, close string, volume string")
    good, bad = series.split_bad_numbers(raw)
    whole, _ = series.split_fractional_volume(good)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # Five values, each to see whether it is a number and to read it.
    assert plan(series.type_records(whole)).count("try_cast(trim(") == 5
    typed, _ = series.split_fractional_volume(series.coerce_numeric(raw, ["volume"]))
    assert plan(typed).count("try_cast(trim(") == 1
    assert bad.columns == [*raw.columns, "bad_columns"] and good.columns == raw.columns


def test_missing_and_bad_numbers_are_told_apart(spark):
    kinds = {"NaN": False, " -Infinity": False, "INF ": False, "1e5": False, ".5": False, "nanx": True, "1_000": True, "": True, "1 nan": True}
    rows = [("a", f"2024-01-{i:02d}", v, "1", "1", "1", "1") for i, v in enumerate(kinds, 1)]
    raw = spark.createDataFrame(rows, "symbol string, date string, open string, high string, low string, close string, volume string")
    good, bad = series.split_bad_numbers(raw)
    assert sorted(r["open"] for r in bad.collect()) == sorted(v for v, wrong in kinds.items() if wrong)
    assert {r["open"] for r in good.collect()} == {None, 1e5, 0.5}


def test_rejects_of_good_numbers_take_one_pass(spark):
    from marketlens.plans import jobs

    docs = spark.createDataFrame(
        [("a", {"2. Symbol": "a"}, {"2024-01-01": {"6. volume": "1.5"}, "2024-01-02": {"6. volume": "2"}}),
         (None, {"2. Symbol": None}, {"2024-01-01": {"6. volume": "3.5"}, "2024-01-02": {"6. volume": "4"}, "2024-01-03": {"1. open": "x"}}),
         ("b", None, None)],
        f"symbol string, `{S.META_KEY}` map<string,string>, `{S.SERIES_KEY}` map<string,map<string,string>>")
    rejected = jobs.rejected_bars(docs)
    found = sorted((r["symbol"] or "", r["date"] or "", r["volume"] or "", r["reason"]) for r in rejected.collect())
    assert found == [("", "2024-01-01", "3.5", "volume"), ("", "2024-01-02", "4.0", "symbol"), ("", "2024-01-03", "", "number: open"),
                     ("a", "2024-01-01", "1.5", "volume"), ("b", "", "", "document")]
    # Documents without their key, rows with bad numbers, rows with good ones.
    assert rejected._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


def test_coverage_keeps_dates_in_one_set_per_symbol(spark):
    rows = [("a", f"2024-01-{d:02d}") for d in (9, 3, 3, 1, 7, 5, 8)] + [("a", None), ("b", "2024-02-01"), ("b", "2024-02-01"), ("c", None)]
    bars = spark.createDataFrame(rows, "symbol string, day string").selectExpr("symbol", "to_date(day) AS trade_date")
    found = series.coverage_report(bars, "2024-01-05")
    assert {r["symbol"]: (r["bars"], r["has_as_of"], r["first_dates"], r["last_dates"]) for r in found.collect()} == {
        "a": (7, True, "2024-01-01,2024-01-03,2024-01-05,2024-01-07,2024-01-08", "2024-01-03,2024-01-05,2024-01-07,2024-01-08,2024-01-09"),
        "b": (2, False, "2024-02-01", "2024-02-01"), "c": (0, None, None, None)}
    # Neither rows nor days are sorted per symbol, and no second table of days is kept in a task.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("+- HashAggregate") == 0


def test_judged_bars_are_the_bars_and_the_rejects(spark):
    from marketlens.plans import jobs
    from marketlens.sources.sinks import conform

    day = {"1. open": "1.5", "2. high": "2", "3. low": "NaN", "4. close": "1", "6. volume": "7"}
    meta, keyed = {"2. Symbol": "x"}, [
        {"2024-01-02": day, "2024-01-03": {**day, "1. open": "abc", "6. volume": "1e300"}, "2024-01-04": {**day, "6. volume": "1.5"},
         "2024-01-05": {}, "2020-01-01": day, "x2024-01-06": day, "2024-01-07": {**day, "1. open": "1_0", "4. close": ""}},
        {"2024-01-02": day}, {"2024-01-02": day}, {}, None,
    ]
    rows = [(s, meta, k) for s in ("a", None) for k in keyed] + [(s, None, k) for s in ("b", None) for k in keyed[2:]]
    docs = spark.createDataFrame(rows, f"symbol string, `{S.META_KEY}` map<string,string>, `{S.SERIES_KEY}` map<string,map<string,string>>")
    judged = jobs.judged_bars(docs)
    bars = judged.where("reason IS NULL").select(*S.TRADES.names).distinct()
    assert sorted(bars.collect(), key=repr) == sorted(conform(jobs.bars_from_documents(docs), S.TRADES).collect(), key=repr) and bars.count() == 3
    wrong = judged.where("reason IS NOT NULL").select("symbol", "arrived.*", "reason")
    wanted = jobs.rejected_bars(docs)
    assert wrong.columns == wanted.columns and sorted(wrong.collect(), key=repr) == sorted(wanted.collect(), key=repr)
    assert {r["reason"] for r in wanted.collect()} == {"document", "number: open", "number: open,close", "volume", "symbol"}
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
