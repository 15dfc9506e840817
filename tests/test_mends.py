"""Small sums, headers that look like others, and many missing values."""

import pytest
from pyspark.sql import functions as F

from cvengine.functions.scalars import money_mean, money_sum
from cvengine.operators import cleaning, order
from cvengine.plans import pipeline


def test_money_keeps_small_and_large_amounts(spark):
    small = spark.range(1000).select(F.lit(0.00004).alias("v")).agg(money_sum(F.col("v")), money_mean(F.col("v"))).first()
    assert small[0] == pytest.approx(0.04) and small[1] == pytest.approx(0.00004)
    large = spark.createDataFrame([(1e15,), (1e30,), (None,)], "v double").agg(money_sum(F.col("v"))).first()[0]
    assert large == pytest.approx(1e30)
    assert spark.createDataFrame([(None,)], "v double").agg(money_sum(F.col("v"))).first()[0] is None


def test_retail_names():
    assert cleaning.retail_names(["Customer ID", "InvoiceNo", "InvoiceDate", "StockCode", "Price"]) == [
        "customer_id",
        "invoice",
        "invoice_date",
        "stock_code",
        "unit_price",
    ]
    assert cleaning.retail_names(["customer_id", "customer_residence", "customer_paid"]) == ["customer_id", "customer_residence", "customer_paid"]
    assert cleaning.retail_names(["Unit Price", "price"]) == ["unit_price", "price"]
    assert cleaning.retail_names(["unit_price", "UnitPrice (GBP)"]) == ["unit_price", "unitprice_(gbp)"]
    assert cleaning.retail_names(["Date of Invoice", "ID of the Customer"]) == ["invoice_date", "customer_id"]


def test_customers_with_a_residence(spark):
    columns = ["customer_id", "customer_residence", "total_purchases", "avg_order_value", "days_since_first_purchase", "days_since_last_purchase"]
    cleaned = pipeline.clean(spark.createDataFrame([("1", "x", 2, 3.0, 9, 4)], columns))
    assert cleaned.first()["customer_residence"] == "x"


def test_transactions_without_prices(spark):
    rows = spark.createDataFrame([("1", "2024-01-01", 5.0)], ["customer_id", "invoice_date", "total_amount"])
    with pytest.raises(ValueError, match="unit_price"):
        pipeline.clean(rows)


def test_missing_values_share_no_partition(spark):
    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 200 == 0, F.col("id").cast("double")).alias("v"))
    ranked = order.percent_rank(rows, "v", "pct", ["id"], cell_rows=30)
    found = ranked.agg(F.count(F.lit(1)), F.count("pct"), F.max("pct")).first()
    assert tuple(found) == (20_000, 100, 100.0)
