"""Per-customer rollup of transactions.

Everything but the median is an algebraic aggregate, combined before the shuffle, so a
customer with a third of all rows costs no more than any other:

* years, months and quarters are bit masks (one distinct count each would multiply the
  rows that are shuffled);
* the preferred day, hour and season come from a handful of counters;
* invoices and products are true distinct counts, which Spark shuffles by customer *and*
  value. They have an aggregate of their own: beside the other measures each of their
  expanded rows would carry all counters through the shuffle.

The median runs separately, see ``grouped_quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine.functions.scalars import money_mean, money_sum
from cvengine.operators.order import CELL_ROWS, grouped_quantiles
from cvengine.session import stage

SEASON_ORDER = ["Fall", "Spring", "Summer", "Winter"]
MASK_BITS = 62


def _distinct_small(col: Column, low: int, high: int) -> Column:
    """Distinct count of an integer known to lie in [low, high], by bit masks."""
    total = F.lit(0)
    for base in range(low, high + 1, MASK_BITS):
        inside = col.between(base, base + MASK_BITS - 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (col - base).cast("int"))
        total = total + F.coalesce(F.bit_count(F.bit_or(F.when(inside, bit))), F.lit(0))
    return total.cast("bigint")


def _counters(name: str, values: list) -> list[Column]:
    return [F.expr(f"count_if({name} = {v!r}) AS __{name}_{i}") for i, v in enumerate(values)]


def _most_frequent(name: str, values: list) -> Column:
    """The most frequent value; ``values`` is sorted, the smallest of tied values wins."""
    counts = f"array({', '.join(f'__{name}_{i}' for i in range(len(values)))})"
    labels = f"array({', '.join(map(repr, values))})"
    return F.expr(f"get({labels}, cast(array_position({counts}, array_max({counts})) AS int) - 1)")


def year_range(transactions: DataFrame) -> tuple[int, int]:
    found = transactions.agg(F.year(F.min("invoice_date")), F.year(F.max("invoice_date"))).first()
    return found[0] or 1970, found[1] or 1970


MODES = {"day_of_week": list(range(7)), "hour": list(range(24)), "season": SEASON_ORDER}


def measures(transactions: DataFrame, years: tuple[int, int]) -> DataFrame:
    """The algebraic measures. ``years`` bounds the years that occur."""
    amount, quantity, price = F.col("total_amount"), F.col("quantity"), F.col("unit_price")
    counters = [c for name, values in MODES.items() for c in _counters(name, values)]
    grouped = transactions.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_purchase"),
        F.max("invoice_date").alias("last_purchase"),
        F.count("invoice_date").alias("total_transactions"),
        money_sum(amount).alias("total_revenue"),
        money_mean(amount).alias("avg_order_value"),
        F.stddev_samp(amount).alias("std_order_value"),
        F.min(amount).alias("min_order_value"),
        F.max(amount).alias("max_order_value"),
        money_sum(quantity).alias("total_quantity"),
        money_mean(quantity).alias("avg_quantity"),
        F.stddev_samp(quantity).alias("std_quantity"),
        F.avg(price).alias("avg_unit_price"),
        F.stddev_samp(price).alias("std_unit_price"),
        _distinct_small(F.col("year"), *years).alias("years_active"),
        _distinct_small(F.col("month"), 1, 12).alias("months_active"),
        _distinct_small(F.col("quarter"), 1, 4).alias("quarters_active"),
        (F.sum("is_weekend") / F.count("is_weekend")).alias("weekend_purchase_rate"),
        *counters,
    )
    preferred = {f"preferred_{name}": _most_frequent(name, values) for name, values in MODES.items()}
    return grouped.withColumns(preferred).drop(*[f"__{n}_{i}" for n, v in MODES.items() for i in range(len(v))])


def breadth(transactions: DataFrame) -> DataFrame:
    """Distinct invoices and products."""
    return transactions.groupBy("customer_id").agg(
        F.count_distinct("invoice").alias("unique_invoices"),
        F.count_distinct("stock_code").alias("unique_products"),
    )


def rollup_without_median(transactions: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Both aggregates end hash-partitioned by customer, so their join adds no shuffle."""
    return measures(transactions, years).join(breadth(transactions), "customer_id")


def staged_rollup(transactions: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """The rollup without the median, staged: edges and scores take passes over it."""
    return stage(rollup_without_median(transactions, years or year_range(transactions)), "rollup")


def median_amounts(transactions: DataFrame, staged: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Median amount per customer: a second, two-column pass over the transactions.

    The staged rollup already knows which customers are too large for one task.
    """
    sizes = staged.select("customer_id", F.col("total_transactions").alias("rows"))
    wanted = {"median_order_value": (1, 2)}
    return grouped_quantiles(transactions, ["customer_id"], "total_amount", wanted, sizes, cell_rows)


def customer_rollup(
    transactions: DataFrame, years: tuple[int, int] | None = None, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """All rollup measures, one row per customer."""
    staged = staged_rollup(transactions, years)
    return staged.join(median_amounts(transactions, staged, cell_rows), "customer_id", "left")
