"""Time split of transactions and the future-value target."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine import fixed_values as fixed
from cvengine.functions.scalars import money_sum
from cvengine.operators.cleaning import is_transactional
from cvengine.operators.order import percent_rank


class Window(NamedTuple):
    """Feature rows lie in [start, end], target rows after end; timestamps as text."""

    start: str
    end: str
    newest: str


def split_window(transactions: DataFrame) -> Window:
    """One aggregate over the date column; its row becomes literals that reach the scan."""
    newest = F.max("invoice_date")
    end = newest - F.make_dt_interval(F.lit(fixed.PREDICTION_DAYS))
    start = end - F.make_dt_interval(F.lit(fixed.LOOKBACK_DAYS))
    found = transactions.agg(*[c.cast("string") for c in (start, end, newest)]).first()
    if found[2] is None:
        raise ValueError("no transactions")
    return Window(*found)


def _years(transactions: DataFrame, first: str, last: str) -> Column:
    """Bounds on ``year`` where the column exists: they prune folders of a table laid out by year."""
    if "year" not in transactions.columns:
        return F.lit(True)
    return F.col("year").between(int(first[:4]), int(last[:4]))


def feature_rows(transactions: DataFrame, window: Window) -> DataFrame:
    kind = transactions.schema["invoice_date"].dataType
    start, end = F.lit(window.start).cast(kind), F.lit(window.end).cast(kind)
    inside = F.col("invoice_date").between(start, end)
    return transactions.where(inside & _years(transactions, window.start, window.end))


def target_rows(transactions: DataFrame, window: Window) -> DataFrame:
    kind = transactions.schema["invoice_date"].dataType
    later = F.col("invoice_date") > F.lit(window.end).cast(kind)
    return transactions.where(later & _years(transactions, window.end, window.newest))


def future_value(targets: DataFrame) -> DataFrame:
    return targets.groupBy("customer_id").agg(money_sum(F.col("total_amount")).alias("predicted_clv"))


def attach_target(features: DataFrame, future: DataFrame) -> DataFrame:
    """Customers without future purchases get 0."""
    return features.join(future, "customer_id", "left").withColumn(
        "predicted_clv", F.coalesce("predicted_clv", F.lit(0.0))
    )


def summary_target(customers: DataFrame) -> DataFrame:
    """Target of customer-level input: purchases times order value, else revenue, else defaults."""
    if "total_purchases" in customers.columns and "avg_order_value" in customers.columns:
        value = F.col("total_purchases") * F.col("avg_order_value")
    elif "total_revenue" in customers.columns:
        value = F.col("total_revenue")
    else:
        purchases = F.col("total_purchases") if "total_purchases" in customers.columns else F.lit(1)
        order = F.col("avg_order_value") if "avg_order_value" in customers.columns else F.lit(50)
        value = purchases * order
    return customers.withColumn("predicted_clv", value.cast("double"))


def needs_split(df: DataFrame) -> bool:
    return is_transactional(df) and "invoice_date" in df.columns


def with_target_percentile(df: DataFrame) -> DataFrame:
    """``df`` should be staged: ranking takes two passes."""
    return percent_rank(df, "predicted_clv", "clv_percentile", ["customer_id"])
