"""Physical plans: what reaches the scan, and what must not appear."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from cvengine.operators import order, rollup, split
from cvengine.session import drop_staged, new_path, stage
from cvengine.sources import sinks, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_bounds_and_columns_reach_the_scan(spark, sf):
    transactions = tables.transactions(spark, sf)
    window = split.split_window(transactions)
    text = plan(rollup.breadth(split.feature_rows(transactions, window)))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_year_folders_are_pruned(spark, sf, tmp_path):
    transactions = tables.transactions(spark, sf)
    path = sinks.export_parquet(transactions, str(tmp_path / "by_year"), ["year"])
    stored = spark.read.parquet(path)
    window = split.split_window(transactions)
    kept = split.feature_rows(stored, window)
    assert "year" in plan(kept).split("PartitionFilters: [")[1].split("]")[0]
    assert kept.count() == split.feature_rows(transactions, window).count()


def test_rollup_aggregates_share_one_partitioning(spark, sf):
    """Rollup and distinct counts meet in a join without shuffling their results again."""
    transactions = tables.transactions(spark, sf)
    both = rollup.rollup_without_median(transactions, rollup.year_range(transactions))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(rollup.rollup_without_median(transactions, (1995, 2001)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_customer = [line for line in text.splitlines() if "Exchange hashpartitioning(customer_id#" in line]
    assert len([line for line in by_customer if line.count("#") <= 2]) == 2
    assert both.count() == transactions.select("customer_id").distinct().count()


def test_rank_window_is_partitioned(spark):
    df = stage(spark.range(3000).select("id", (F.col("id") % 1000).cast("double").alias("v")))
    text = plan(order.percent_rank(df, "v", "r", ["id"], cell_rows=100))
    assert "Exchange hashpartitioning(__bucket" in text and "SinglePartition" not in text


@pytest.mark.parametrize("name", ["flagship_segment_revenue", "m17_score_enrichment", "d7_new_record_rules", "fn_clean_text"])
def test_no_python_workers_and_no_cartesian_products(spark, sf, name):
    text = plan(entry_points.queries()[name](spark, sf))
    for operator in ("EvalPython", "CartesianProduct", "MapInPandas", "FlatMapGroups"):
        assert operator not in text


def test_staged_tables_can_be_dropped(spark):
    df = stage(spark.range(3).toDF("v"))
    unwritten = new_path(spark, "never")
    assert df.count() == 3 and unwritten
    drop_staged(spark)
    with pytest.raises(Exception):
        df.count()


def test_quality_score_makes_no_row_per_column(spark, sf, monkeypatch):
    """Neither the plan of the score nor any pass on the way to it turns rows into one row per column."""
    from cvengine.operators import quality

    lines = tables.table(spark, sf, "lineitem")
    exploded = []
    real = F.explode
    monkeypatch.setattr(F, "explode", lambda c: exploded.append(c) or real(c))
    assert "Generate" not in plan(quality.outlier_rate(lines)) and "Generate" not in plan(quality.quality_score(lines))
    assert not exploded
    # in selection from large columns only values between brackets are exploded, after a filter
    small = quality.outlier_bounds(lines, ["l_quantity", "l_extendedprice"], cell_rows=500)
    assert exploded and small == quality.outlier_bounds(lines, ["l_quantity", "l_extendedprice"])


def test_positions_without_a_range_sort(spark, sf):
    customers = tables.customers(spark, sf).select("total_purchases", "customer_id")
    placed = order.row_positions(customers, ["total_purchases", "customer_id"], customers.count(), cell_rows=10)
    text = plan(placed)
    assert "rangepartitioning" not in text and "hashpartitioning(__bucket" in text


def test_cutoff_reaches_the_scan(spark, sf, tmp_path):
    """A trailing window over a stored log is a pushed filter, not a join."""
    from cvengine.operators import logs
    from cvengine.plans import input_queries

    path = sinks.export_parquet(tables.feedback(spark, sf), str(tmp_path / "log"))
    log = spark.read.parquet(path)
    text = plan(logs.trailing(log, input_queries._newest(log), 24))
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThan(timestamp" in text and "Join" not in text
