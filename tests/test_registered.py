"""Every registered query beside its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as registered
from tools.check import TABLES, sql_rows, table_rows

SLOW = {"forecast_gbt", "forecast_seq_reservoir", "forecast_rf", "forecast_seq", "model_metrics"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - SLOW))
def test_query_matches_sql(spark, connection, sf_dir, name):
    df = registered.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    found = table_rows([tuple(r) for r in df.collect()], df.columns)
    assert found
    sql = registered.oracle_sql().get(name)
    if sql:
        names, rows = sql_rows(connection, sql)
        assert sorted(names) == sorted(df.columns)
        assert found == table_rows(rows, names)


def test_entry(spark):
    assert registered.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["dedup_news_first", "answer_history", "similar_articles", "vector_upsert"])
def test_hot_keys_are_cut_before_the_shuffle(spark, sf_dir, name):
    plan = registered.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_first_bars_use_the_partitioning_that_is_there(spark, sf_dir):
    # Both inputs are bars, grouped by symbol and date; their two shuffles are the only ones.
    plan = registered.queries()["dedup_bar_first"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = registered.queries()["filter_as_of"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan
    plan = registered.queries()["answer_prediction"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "model" in plan.split("PartitionFilters: [")[2].split("]")[0] or "(model" in plan
