"""Sample customers and transactions.

Draws are hashes of the row's own key, so a task that runs again, or another number of
partitions, gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.operators.cleaning import calendar_columns

# fixed values: sample domains and their weights
CHANNELS = {"online": 0.4, "store": 0.3, "social": 0.2, "referral": 0.1}
LOCATIONS = {"urban": 0.5, "suburban": 0.35, "rural": 0.15}
STATUSES = {"active": 0.3, "inactive": 0.2, "none": 0.5}
COUNTRIES = ["us", "uk", "de", "fr"]
ANALYSIS_DAYS = 540
LONGEST_DAYS = 1095
SHORTEST_DAYS = 180


def uniform(seed: int, draw: str, *keys: str) -> Column:
    """Uniform in (0, 1), a function of seed, draw name and keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(draw), *keys), 11)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def exponential(u: Column, mean: float) -> Column:
    return -F.log(u) * mean


def normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def poisson(mean: Column, u: Column, largest: int = 100) -> Column:
    """The smallest k whose cumulative probability reaches ``u``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(state: Column, i: Column) -> Column:
        p = state["p"] * mean / i
        more = state["cdf"] < u
        return F.struct(
            p.alias("p"), (state["cdf"] + p).alias("cdf"), F.when(more, i).otherwise(state["k"]).alias("k")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(largest)), start, step, lambda s: s["k"])


def pick(u: Column, weights: dict[str, float]) -> Column:
    names, total = list(weights), 0.0
    chosen = F.lit(names[-1])
    edges = []
    for name in names[:-1]:
        total += weights[name]
        edges.append((total, name))
    for edge, name in reversed(edges):
        chosen = F.when(u < edge, name).otherwise(chosen)
    return chosen


def _even(names) -> dict[str, float]:
    return {n: 1 / len(names) for n in names}


def _ids(spark: SparkSession, count: int) -> DataFrame:
    number = F.col("id") + 1
    width = F.greatest(F.lit(4), F.length(number.cast("string")))
    return spark.range(count).select(F.concat(F.lit("cust_"), F.lpad(number.cast("string"), width, F.lit("0"))).alias("customer_id"))


def sample_customers(spark: SparkSession, count: int = 100, asof: str | None = None, seed: int = 42) -> DataFrame:
    def u(draw: str) -> Column:
        return uniform(seed, draw, "customer_id")

    def clip(value: Column, low, high) -> Column:
        return F.least(F.greatest(value, F.lit(low)), F.lit(high) if not isinstance(high, Column) else high)

    moment = F.current_timestamp() if asof is None else F.lit(asof).cast("timestamp")
    first = clip(exponential(u("first"), 400) + SHORTEST_DAYS, SHORTEST_DAYS, LONGEST_DAYS).cast("bigint")
    people = _ids(spark, count).withColumn("days_since_first_purchase", first)
    longest = F.least(F.col("days_since_first_purchase"), F.lit(ANALYSIS_DAYS)).cast("double")
    visit = clip(exponential(u("visit"), 90), 7.0, float(ANALYSIS_DAYS)) * 86400
    return people.select(
        "customer_id",
        clip(40 + 15 * normal(u("age1"), u("age2")), 18, 80).cast("bigint").alias("age"),
        clip(poisson(F.lit(15.0), u("purchases")), 5, 100).cast("bigint").alias("total_purchases"),
        F.round(clip(F.exp(3.7 + 0.7 * normal(u("order1"), u("order2"))), 15.0, 1000.0), 2).alias("avg_order_value"),
        "days_since_first_purchase",
        clip(exponential(u("last"), 90), 0.0, longest).cast("bigint").alias("days_since_last_purchase"),
        pick(u("channel"), CHANNELS).alias("acquisition_channel"),
        pick(u("location"), LOCATIONS).alias("location"),
        pick(u("status"), STATUSES).alias("subscription_status"),
        (moment - F.make_dt_interval(secs=visit.cast("decimal(18,6)"))).alias("invoice_date"),
    )


def sample_transactions(spark: SparkSession, count: int = 100, asof: str | None = None, seed: int = 42) -> DataFrame:
    """Evenly spaced purchases over each customer's lifetime, none after ``asof``."""

    def per_customer(draw: str) -> Column:
        return uniform(seed, draw, "customer_id")

    def per_row(draw: str) -> Column:
        return uniform(seed, draw, "customer_id", "i")

    moment = F.current_timestamp() if asof is None else F.lit(asof).cast("timestamp")
    lives = _ids(spark, count).select(
        "customer_id",
        (ANALYSIS_DAYS + F.floor(per_customer("life") * (LONGEST_DAYS - ANALYSIS_DAYS))).alias("life"),
        F.floor(per_customer("start") * 180).cast("int").alias("start"),
        F.exp(3.7 + 0.7 * normal(per_customer("spend1"), per_customer("spend2"))).alias("spend"),
    )
    lives = lives.withColumn("n", F.greatest(F.lit(5), poisson(F.col("life") / 60.0, per_customer("n"))))
    rows = lives.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    day = F.col("start") + F.floor(F.col("life") * F.col("i") / F.col("n")).cast("int")
    rows = rows.withColumn("invoice_date", F.date_add(F.lit("2022-01-01").cast("date"), day).cast("timestamp"))
    rows = rows.where(F.col("invoice_date") <= moment)
    rows = rows.select(
        "customer_id",
        F.concat_ws("-", F.lit("inv"), "customer_id", F.col("i").cast("string")).alias("invoice"),
        "invoice_date",
        F.round(F.col("spend") * (0.7 + 0.8 * per_row("amount")), 2).alias("total_amount"),
        F.greatest(F.lit(1), poisson(F.lit(2.0), per_row("quantity"), 20)).cast("bigint").alias("quantity"),
        F.concat(F.lit("prod_"), (1000 + F.floor(per_row("product") * 8999)).cast("string")).alias("product_id"),
        pick(per_row("country"), _even(COUNTRIES)).alias("country"),
        pick(per_row("channel"), _even(CHANNELS)).alias("acquisition_channel"),
        pick(per_row("location"), _even(LOCATIONS)).alias("location"),
        pick(per_row("status"), _even(STATUSES)).alias("subscription_status"),
    )
    priced = rows.withColumns(
        {"stock_code": F.col("product_id"), "unit_price": F.col("total_amount") / F.col("quantity")}
    )
    return calendar_columns(priced)
