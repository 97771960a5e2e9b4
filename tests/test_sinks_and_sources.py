import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas as S
from marketlens.operators import news as N
from marketlens.operators.features import BAR_VALUES
from marketlens.plans import jobs, views
from marketlens.sources import landing, scratch, sinks
from marketlens.streaming import ingest
from tests_support import make_bars


@pytest.fixture(scope="module")
def db(spark):
    spark.sql("DROP DATABASE IF EXISTS market CASCADE")
    assert set(S.create_tables(spark, "market")) == set(S.TABLES)
    assert S.create_tables(spark, "market") == []
    yield "market"
    spark.sql("DROP DATABASE market CASCADE")


def day(n):
    return {f: str(n + i) for i, f in enumerate(S.BAR_FIELDS.values())}


def test_declared_tables(spark, db):
    for name, (schema, _) in S.TABLES.items():
        found = spark.table(f"{db}.{name}").schema
        assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in schema], name


def test_one_file_per_symbol(spark, tmp_path, db):
    for symbol, n in (("AAPL", 1), ("MSFT", 5)):
        doc = {S.META_KEY: {"2. Symbol": symbol}, S.SERIES_KEY: {"2024-01-02": day(n), "2023-04-01": day(n)}}
        (tmp_path / f"filtered_{symbol}_data.json").write_text(json.dumps(doc, indent=1))
    pattern = r"filtered_(\w+)_data\.json"
    for _ in range(2):
        jobs.load_trades(spark, f"{tmp_path}/filtered_*.json", f"{db}.trades", name_pattern=pattern)
    rows = spark.table(f"{db}.trades").orderBy("symbol").collect()
    assert [(r["symbol"], r["open"], r["volume"]) for r in rows] == [("AAPL", 1.0, 5), ("MSFT", 5.0, 9)]


def test_records_file(spark, tmp_path):
    (tmp_path / "parsed.json").write_text(json.dumps([{"symbol": "A", "date": "2024-01-02", "open": None, "volume": 3.0}]))
    row = landing.read_records(spark, str(tmp_path / "parsed.json")).first()
    assert row["symbol"] == "A" and row["open"] is None and row["volume"] == 3.0


def test_news_files_keep_feed_order(spark, tmp_path):
    items = [{"title": f"t{i}", "summary": "s", "overall_sentiment_score": None} for i in range(3)] + [{"title": "t3"}]
    (tmp_path / "news_AAPL_data.json").write_text(json.dumps(items, indent=2))
    (tmp_path / "news_MSFT_data.json").write_text("[]")
    pattern = r"news_(\w+)_data\.json"
    rows = landing.read_news(spark, str(tmp_path), name_pattern=pattern).orderBy("feed_pos").collect()
    assert [(r["feed_symbol"], r["feed_pos"], r["title"]) for r in rows] == [("AAPL", i, f"t{i}") for i in range(4)]
    variants = N.project_variant_news(landing.read_news_variant(spark, str(tmp_path), name_pattern=pattern), extra=["feed_pos"])
    assert [r["original_sentiment_score"] for r in variants.orderBy("feed_pos").collect()] == [None, None, None, 0.0]


def test_unreadable_filings_are_set_aside(spark, tmp_path, db):
    recent = {"form": ["10-K"], "filingDate": ["2024-01-01"], "primaryDocument": ["a b"], "primaryDocDescription": ["d"]}
    (tmp_path / "raw_A.json").write_text(json.dumps({"company_name": "A", "cik": "1", "filings": {"recent": recent}}, indent=2))
    (tmp_path / "raw_B.json").write_text("{ not json")
    unreadable = jobs.load_filings(spark, str(tmp_path), f"{db}.filings_10k")
    assert unreadable.count() == 1
    assert [r["document_links"] for r in spark.table(f"{db}.filings_10k").collect()] == [["a", "b"]]


def test_csv_types_and_latest_snapshot(spark, tmp_path):
    bars = make_bars(spark, {"a": 5})
    for stamp, count in (("20240101000000", 2), ("20231231235959", 5)):
        sinks.write_csv(bars.limit(count), f"{tmp_path}/train_stock_data_{stamp}.csv")
    pattern = r"train_stock_data_(\d{14})\.csv"
    assert landing.latest_snapshot_path(spark, str(tmp_path), pattern).endswith("train_stock_data_20240101000000.csv")
    latest = landing.read_latest_csv(spark, str(tmp_path), pattern, bars.schema)
    assert latest.count() == 2 and latest.schema == bars.schema
    with pytest.raises(FileNotFoundError):
        landing.latest_snapshot_path(spark, str(tmp_path), r"valid_(\d{14})\.csv")


def test_snapshot_runs_are_pruned(spark, tmp_path):
    path = str(tmp_path / "runs")
    for stamp in ("20240101000000", "20240102000000"):
        jobs.store_features(make_bars(spark, {"a": 60}, seed=int(stamp[:8])), path, stamp)
    latest = landing.read_latest_run(spark, path)
    assert latest.count() == 54 and {str(r[0]) for r in latest.select("run_ts").distinct().collect()} == {"20240102000000"}
    plan = landing.read_latest_run(spark, path, "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_ts" in plan


def test_json_sink_replaces_only_its_symbols(spark, tmp_path):
    path = str(tmp_path / "json")
    bars = make_bars(spark, {"a": 5, "b": 4})
    sinks.write_json(bars, path)
    sinks.write_json(bars.where("symbol = 'a'").limit(2), path)
    counts = {r["symbol"]: r["count"] for r in spark.read.schema(S.TRADES).json(path).groupBy("symbol").count().collect()}
    assert counts == {"a": 2, "b": 4}


def test_row_inserts(spark, db):
    rows = spark.createDataFrame([("a", "2024-01-01", "1.5"), ("b", "bad", "1"), (None, "2024-01-01", "2")],
                                 "symbol string, trade_date string, volume_prediction string")
    rows = rows.withColumns({"close_prediction": F.lit("2"), "model": F.lit("seq_a")})
    table = f"{db}.predictions"
    with pytest.raises(ValueError):
        sinks.insert_rows(rows, table, required=["symbol"])
    assert spark.table(table).count() == 0
    bad = sinks.insert_rows(rows, table, required=["symbol"], on_error="log")
    assert bad.count() == 2 and spark.table(table).count() == 1


def test_fractions_do_not_fit_whole_numbers(spark):
    df = spark.createDataFrame([(2.0,), (2.7,), (None,)], "volume double")
    good, bad = sinks.split_conforming(df, T.StructType([T.StructField("volume", T.LongType())]))
    assert [r[0] for r in good.collect()] == [2, None] and [r[0] for r in bad.collect()] == [2.7]


def prediction(spark, date, close):
    return spark.createDataFrame([("a", date, 1.0, close)], "symbol string, trade_date date, volume_prediction double, close_prediction double")


def test_replacing_predictions_and_date_guard(spark, db):
    table, today = f"{db}.predictions", datetime.date(2024, 1, 1)
    jobs.store_forecasts({"rf": prediction(spark, today, 1.0), "gbt": prediction(spark, today, 2.0)}, table)
    jobs.store_forecasts({"rf": prediction(spark, today, 3.0)}, table)
    found = {r["model"]: r["close_prediction"] for r in spark.table(table).where("model <> 'seq_a'").collect()}
    assert found == {"rf": 3.0, "gbt": 2.0}
    with pytest.raises(Exception, match="invalid date"):
        sinks.replace_model(prediction(spark, None, 1.0), table, "rf")
    sinks.replace_table(prediction(spark, today, 9.0).withColumn("model", F.lit("x")), table, on_date="trade_date")
    assert [r["model"] for r in spark.table(table).collect()] == ["x"]
    with pytest.raises(Exception, match="invalid date"):
        sinks.guard_dates(prediction(spark, None, 1.0)).select("symbol").collect()


def test_news_table_stays_distinct(spark, db):
    feed = spark.createDataFrame(
        [("A", 0, "t", "good", 0.5, "L", "s", "20240101T000000")],
        "feed_symbol string, feed_pos int, title string, summary string, overall_sentiment_score double, "
        "overall_sentiment_label string, source string, time_published string")
    for _ in range(2):
        jobs.load_news(feed, N.lexicon_frame(spark), f"{db}.news_sentiment")
    assert spark.table(f"{db}.news_sentiment").count() == 1


def test_loading_news_leaves_stored_files_alone(spark, db):
    schema = ("feed_symbol string, feed_pos int, title string, summary string, overall_sentiment_score double, "
              "overall_sentiment_label string, source string, time_published string")
    rows = [("A", i, f"kept{i}", "good" if i else None, None, None, "s", f"2023010{i + 1}T000000") for i in range(3)]
    table, stored = spark.table(f"{db}.news_sentiment"), set()
    for n in (2, 3, 3):
        jobs.load_news(spark.createDataFrame(rows[:n], schema), N.lexicon_frame(spark), f"{db}.news_sentiment")
        spark.catalog.refreshTable(f"{db}.news_sentiment")
        files = set(spark.table(f"{db}.news_sentiment").inputFiles())
        assert stored <= files
        stored = files
        assert spark.table(f"{db}.news_sentiment").where("headline like 'kept%'").count() == n
    assert table.columns == S.NEWS_SENTIMENT.names


def test_older_runs_are_not_opened(spark, tmp_path):
    import pathlib

    path = str(tmp_path / "runs")
    for run in ("20240101000000", "20240301120000"):
        sinks.write_snapshot(spark.createDataFrame([("a", run, "train"), ("b", run, "test")], "k string, v string, split string"), path, run)
    for file in pathlib.Path(path).glob("run_ts=20240101000000/*/*.parquet"):
        file.write_bytes(b"not parquet at all")
    assert sorted((r["k"], r["v"], r["run_ts"]) for r in landing.read_latest_run(spark, path).collect()) == [
        ("a", "20240301120000", 20240301120000), ("b", "20240301120000", 20240301120000)]
    assert [r["k"] for r in landing.read_latest_run(spark, path, "train").collect()] == ["a"]
    plain = str(tmp_path / "plain")
    spark.range(2).write.parquet(plain)
    with pytest.raises(FileNotFoundError):
        landing.latest_run_name(spark, plain)


def test_queries(spark, db):
    assert landing.run_query(spark, f"SELECT * FROM {db}.trades WHERE symbol = :s", {"s": "none"}) is None
    bars = make_bars(spark, {"a": 3})
    found = landing.param_query(spark, "SELECT * FROM {bars} WHERE symbol = :s", {"s": "a' OR 1=1 --"}, bars=bars)
    assert found.count() == 0


def test_only_new_rows_are_appended(spark, db):
    bars = make_bars(spark, {"n": 4}).withColumn("open", F.when(F.col("open") > 5, F.col("open")))
    for _ in range(2):
        sinks.append_new_rows(bars, f"{db}.trades", ["symbol", "trade_date", *BAR_VALUES])
    assert spark.table(f"{db}.trades").where("symbol = 'n'").count() == 4


def test_an_append_reads_only_its_own_dates(spark, db):
    bars = make_bars(spark, {"w": 4})
    undated = bars.limit(1).withColumn("trade_date", F.lit(None).cast("date"))
    for rows, total in ((bars, 4), (bars, 4), (bars.unionByName(undated), 5), (undated, 5), (bars.limit(0), 5)):
        sinks.append_new_rows(rows, f"{db}.trades", ["symbol", "trade_date", *BAR_VALUES], within="trade_date")
        assert spark.table(f"{db}.trades").where("symbol = 'w'").count() == total
    near = spark.table(f"{db}.trades").where(sinks._range_of(bars, "trade_date"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(trade_date" in plan and "LessThanOrEqual(trade_date" in plan


def test_streams_take_only_new_files(spark, tmp_path):
    landed, out, bad, progress = (str(tmp_path / n) for n in ("in", "out", "bad", "progress"))
    doc = {S.META_KEY: {S.META_SYMBOL: "A"}, S.SERIES_KEY: {"2024-01-02": day(1), "2020-01-02": day(1)}}
    late = {**doc, S.SERIES_KEY: {"2024-01-02": day(1), "2024-02-03": day(2), "x2024": day(2), "2024-01-04": {**day(2), "1. open": "abc"}}}
    gated = {"symbol": "B", S.SERIES_KEY: {"2024-01-02": day(1)}}
    for batch, total in (([doc], 1), ([late, gated], 3), ([late], 3)):
        spark.createDataFrame([(json.dumps(d),) for d in batch], "value string").write.mode("append").text(landed)
        ingest.run_bars(ingest.stream_series(spark, landed), out, bad, progress)
        assert spark.read.schema(ingest.STORED_BARS).parquet(out).count() == total
    found = sorted((r["batch"], r["symbol"], r["date"], r["reason"]) for r in spark.read.parquet(bad).fillna("").collect())
    assert found == [(1, "A", "2024-01-04", "number: open"), (1, "B", "", "document"), (2, "A", "2024-01-04", "number: open")]


def test_symbol_of_a_series_document(spark, tmp_path):
    docs = {"filtered_AA_data.json": {}, "filtered_BB_data.json": {S.META_KEY: {S.META_SYMBOL: "B2"}},
            "filtered_CC_data.json": {S.META_KEY: {S.META_SYMBOL: "C2"}, "symbol": "C1"}, "plain.json": {}}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps({**doc, S.SERIES_KEY: {"2024-01-02": day(1)}}, indent=1))
    found = [landing.read_series(spark, str(tmp_path), name_pattern=p).collect() for p in (None, landing.SERIES_NAME)]
    assert [sorted(r["symbol"] or "" for r in rows) for rows in found] == [["", "AA", "B2", "C1"], ["", "AA", "BB", "CC"]]


def test_filings_are_named_by_their_file(spark, tmp_path):
    recent = {"form": ["10-K"], "filingDate": ["2024-01-01"], "primaryDocument": ["a b"], "primaryDocDescription": ["d"]}
    for name, doc in (("raw_AAPL_10k", {}), ("raw_ZZ_10k", {"cik": "7"}), ("other", {"company_name": "O", "cik": "8"})):
        (tmp_path / f"{name}.json").write_text(json.dumps({**doc, "filings": {"recent": recent}}, indent=1))
    rows, _ = jobs.filings_from_files(spark, str(tmp_path))
    assert sorted((r["company_name"], r["cik"]) for r in rows.collect()) == [("AAPL", "0000320193"), ("O", "8"), ("ZZ", "7")]


def test_first_article_by_order_of_files(spark, tmp_path):
    item = {"title": "t", "summary": "good", "source": "s", "time_published": "20240101T000000"}
    for part, score in (("b", 2.0), ("a", 1.0), ("c", None)):
        (tmp_path / part).mkdir()
        filler = [{**item, "title": f"{part}{i}", "overall_sentiment_score": None} for i in range(2)]
        (tmp_path / part / "news_A_data.json").write_text(json.dumps([*filler, {**item, "overall_sentiment_score": score}]))
    feed = landing.read_news_variant(spark, f"{tmp_path}/*", name_pattern=landing.NEWS_NAME)
    half = F.pandas_udf(lambda texts: texts.str.len() / 8, "double")
    rows = jobs.news_from_feed(feed, half).collect()
    kept = {r["headline"]: r["original_sentiment_score"] for r in rows}
    assert kept == {"t": 1.0, **{f"{p}{i}": None for p in "abc" for i in range(2)}}
    assert {(r["custom_sentiment_score"], r["custom_sentiment_label"]) for r in rows} == {(0.5, "Positive")}


def test_a_scorer_without_a_number_counts_as_neutral(spark):
    scores = N.score_sentiment(spark.createDataFrame([("x",), (None,), ("yy",)], "summary string"),
                               lambda t: F.when(t == "x", F.lit(float("nan"))).when(t == "yy", F.lit(-7.0)))
    assert sorted(r["custom_sentiment_score"] for r in scores.collect()) == [-1.0, 0.0, 0.0]


def test_stream_keeps_the_first_of_a_batch_and_its_nulls(spark, tmp_path):
    landed, out, bad, progress = (str(tmp_path / n) for n in ("in", "out", "bad", "progress"))
    item = {"title": "t", "summary": "very good", "source": "s", "time_published": "20240101T000000"}
    array = json.dumps([{**item, "overall_sentiment_score": None}, {**item, "overall_sentiment_score": 3.0}, {**item, "title": "u"}])
    spark.createDataFrame([(array,), ("{broken",), (json.dumps({**item, "title": "v", "overall_sentiment_label": "L"}),)], "value string").coalesce(1).write.text(landed)
    ingest.run_news(ingest.stream_news(spark, landed), out, bad, progress)
    found = spark.read.schema(ingest.STORED_NEWS).parquet(out).orderBy("headline").collect()
    assert [(r["headline"], r["original_sentiment_score"], r["original_sentiment_label"], r["custom_sentiment_label"]) for r in found] == [
        ("t", None, "Unknown", "Positive"), ("u", 0.0, "Unknown", "Positive"), ("v", 0.0, "L", "Positive")]
    assert [r["line"] for r in spark.read.parquet(bad).collect()] == ["{broken"]


def test_stream_news_keeps_one_of_each(spark, tmp_path):
    landed, out, bad, progress = (str(tmp_path / n) for n in ("in", "out", "bad", "progress"))
    times = ["20240101T000000", "20240101T000000", "20240102T000000", "20240102T0000"]
    items = [{"title": "t", "summary": "s", "source": "x", "time_published": t} for t in times]
    old = {**items[0], "time_published": "20230101T000000"}
    for batch in (items, [old, *items[:1], *items[2:3]]):
        spark.createDataFrame([(json.dumps(i),) for i in batch], "value string").coalesce(1).write.mode("append").text(landed)
        ingest.run_news(ingest.stream_news(spark, landed), out, bad, progress)
    # An article that is a year late is kept, repeats are not, and a time that does not parse is set aside.
    found = spark.read.schema(ingest.STORED_NEWS).parquet(out)
    assert [str(r[0]) for r in found.select("published_date").orderBy("published_date").collect()] == ["2023-01-01", "2024-01-01", "2024-01-02"]
    assert [r["time_published"] for r in spark.read.parquet(bad).collect()] == ["20240102T0000"]


def test_loading_trades_returns_what_it_sets_aside(spark, tmp_path, db):
    docs = [
        {"symbol": "RJ", S.META_KEY: {"a": "b"}, S.SERIES_KEY: {
            "2024-01-02": day(1), "2024-01-03": {**day(2), "1. open": "abc"}, "2024-01-04": {**day(2), S.BAR_FIELDS["volume"]: "1.5"}}},
        {"symbol": "RK", S.SERIES_KEY: {"2024-01-02": day(1)}},
    ]
    landed = str(tmp_path / "docs")
    spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").write.text(landed)
    rejected = jobs.load_trades(spark, landed, f"{db}.trades", lines=True)
    found = sorted((r["symbol"], r["date"] or "", r["reason"]) for r in rejected.collect())
    assert found == [("RJ", "2024-01-03", "number: open"), ("RJ", "2024-01-04", "volume"), ("RK", "", "document")]
    assert spark.table(f"{db}.trades").where("symbol = 'RJ'").count() == 1


def test_shared_folder(spark):
    assert scratch.shared_folder(spark) == scratch.shared_folder(spark)
    assert scratch.staged(spark.range(3), "numbers").count() == 3


def test_staged_tables_can_be_removed(spark):
    import os

    kept, gone = scratch.staged(spark.range(5).toDF("a"), "kept"), scratch.staged(spark.range(5).toDF("a"), "gone")
    folder = gone.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    scratch.discard(gone)
    assert not os.path.exists(folder) and kept.count() == 5
    with pytest.raises(AttributeError):
        scratch.discard(spark.range(1))


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    spark.createDataFrame([(f"S{i}", i) for i in range(60)], "symbol string, volume long").write.partitionBy("symbol").json(str(tmp_path / "bars"))
    before, tracker = spark.conf.get(landing.LISTING_TASKS), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        with landing.listed_in_few_tasks(spark):
            found = spark.read.schema("volume long").option("recursiveFileLookup", "true").json(str(tmp_path / "bars"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism < 60
    assert found.count() == 60 and spark.conf.get(landing.LISTING_TASKS) == before


def test_a_news_batch_writes_its_texts_twice_at_most_before_they_are_stored(spark, tmp_path, monkeypatch):
    written, stage = [], ingest.staged
    monkeypatch.setattr(ingest, "staged", lambda df, name, *more: written.append((name, *more)) or stage(df, name, *more))
    items = [{"title": f"t{i}", "summary": "s" * 50, "source": "x", "time_published": "20240101T000000"} for i in (1, 2, 2)]
    spark.createDataFrame([(json.dumps(i),) for i in items] + [("{broken",)], "value string").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "feed"))
    ingest.run_news(ingest.stream_news(spark, str(tmp_path / "feed")), str(tmp_path / "out"), str(tmp_path / "rejected"), str(tmp_path / "progress"))
    assert written == [("news-items", "zstd"), ("news-first", "zstd")]
    assert sorted(r["headline"] for r in spark.read.schema(ingest.STORED_NEWS).parquet(str(tmp_path / "out")).collect()) == ["t1", "t2"]
    assert [r["line"] for r in spark.read.parquet(str(tmp_path / "rejected")).collect()] == ["{broken"]


def test_streamed_documents_are_built_once_and_parsed_in_compiled_methods(spark, monkeypatch):
    from marketlens.plans import bar_queries

    limits, stage = [], scratch.staged

    def staged(df, name, *more):
        limits.append((name, df.sparkSession.conf.get("spark.sql.codegen.hugeMethodLimit")))
        return stage(df, name, *more)

    monkeypatch.setattr(ingest, "staged", staged)
    monkeypatch.setattr(bar_queries, "staged", staged, raising=False)
    bars = make_bars(spark, {"a": 40, "b": 30})
    docs = views.series_documents(bars.select("symbol", F.col("trade_date").cast("string").alias("date"),
                                              *[F.col(c).cast("string").alias(c) for c in BAR_VALUES]))
    stored, rejected = bar_queries._streamed(spark, docs)
    assert stored.count() == bars.distinct().count() and rejected.count() == 0
    assert [n for n, _ in limits].count("documents") == 1
    assert [v for n, v in limits if n == "batch-bars"] == ["8000"] * 2


def test_a_bars_batch_is_parsed_once_and_written_once_before_it_is_stored(spark, monkeypatch):
    from marketlens.plans import bar_queries

    written, landed, parsed, stage, write = [], [], [], ingest.staged, ingest.stream_series
    monkeypatch.setattr(ingest, "staged", lambda df, name, *more: written.append((name, *more)) or stage(df, name, *more))
    monkeypatch.setattr(ingest, "stream_series", lambda session, folder, **more: landed.append(folder) or write(session, folder, **more))
    for name in ("bars_from_documents", "rejected_bars", "judged_bars"):
        monkeypatch.setattr(jobs, name, lambda *a, name=name, run=getattr(jobs, name), **k: parsed.append(name) or run(*a, **k))
    raw = views.raw_bars(make_bars(spark, {"a": 40, "b": 30}))
    stored, rejected = bar_queries._streamed(spark, views.series_documents(raw))
    assert written == [("batch-bars", "zstd")] * 2 and parsed == ["judged_bars"] * 2
    assert stored.count() == stored.distinct().count() > 50 and rejected.count() == 2 * rejected.drop("batch").distinct().count() > 0
    # What lands is compressed, and no digest is stored with a bar.
    assert all(r[0].endswith(".json.gz") for r in spark.read.format("binaryFile").load(landed[0]).select("path").collect())
    assert [f.name for f in ingest.STORED_BARS] == [*S.TRADES.names, "trade_month"]


def test_bars_are_built_once_for_both_json_writes_and_lie_there_compressed(spark, sf_dir, monkeypatch):
    from marketlens.plans import bar_queries

    built, paths, trades, write = [], [], views.trades, sinks.write_json
    monkeypatch.setattr(views, "trades", lambda *a: built.append(a) or trades(*a))
    monkeypatch.setattr(bar_queries, "staged", lambda df, *more: built.append(more) or scratch.staged(df, *more))
    monkeypatch.setattr(sinks, "write_json", lambda df, path, **more: paths.append((path, df._staged_path)) or write(df, path, **more))
    found = bar_queries.sink_json_roundtrip(spark, sf_dir)
    assert built == [(spark, sf_dir), ("json-bars", "zstd")] and len(paths) == 2 and len(set(paths)) == 1
    files = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths[0][0]).select("path").collect()]
    assert files and all(f.endswith(".json.gz") for f in files)
    bars = trades(spark, sf_dir)
    assert found.count() == bars.count() and found.exceptAll(bars.select(*S.TRADES.names)).isEmpty()
