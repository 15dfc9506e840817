"""The bundled star-schema tables seen as transactions, customers, actions and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.functions.scalars import money_sum, whole_days
from cvengine.operators.cleaning import calendar_columns


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """Clean transactions: one row per order line, of orders from ``since`` on."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if since:
        orders = orders.where(F.col("o_orderdate") >= F.lit(since).cast(orders.schema["o_orderdate"].dataType))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderkey").cast("string").alias("invoice"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.col("o_orderdate").alias("invoice_date"),
        F.col("l_quantity").alias("quantity"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
        F.col("l_extendedprice").alias("total_amount"),
    )
    return calendar_columns(joined)


def raw_retail(spark: SparkSession, folder: str) -> DataFrame:
    """Uncleaned retail rows as text: returns, free items, bad dates and missing ids occur."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_returnflag"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    price = F.when(F.col("l_discount") == 0, 0.0).otherwise(F.try_divide("l_extendedprice", "l_quantity"))
    day = F.when(F.col("l_tax") == 0.08, "not-a-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("Invoice No"),
        F.col("l_linenumber").cast("string").alias("Line"),
        F.col("l_partkey").cast("string").alias("Stock Code"),
        quantity.cast("string").alias("Quantity"),
        day.alias("Invoice Date"),
        price.cast("string").alias("Price"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey").cast("string")).alias("Customer ID"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with orders; days count back from the newest order."""
    orders = table(spark, folder, "orders")
    newest = F.broadcast(orders.agg(F.max("o_orderdate").alias("asof")))
    summary = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total_purchases"),
        (money_sum(F.col("o_totalprice")) / F.count("o_totalprice")).alias("avg_order_value"),
        F.min("o_orderdate").alias("first"),
        F.max("o_orderdate").alias("last"),
    )
    people = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    balance = F.col("c_acctbal")
    status = F.when(balance < 0, "none").when(balance < 5000, "inactive").otherwise("active")
    return (
        people.join(summary, people.c_custkey == summary.o_custkey)
        .join(nation, people.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .crossJoin(newest)
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            (F.lit(18) + F.col("c_custkey") % 70).cast("bigint").alias("age"),
            "total_purchases",
            "avg_order_value",
            whole_days(F.col("first"), F.col("asof")).alias("days_since_first_purchase"),
            whole_days(F.col("last"), F.col("asof")).alias("days_since_last_purchase"),
            F.col("c_mktsegment").alias("acquisition_channel"),
            F.col("r_name").alias("location"),
            status.alias("subscription_status"),
        )
    )


def actions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("action"),
        F.from_json("props", "map<string,string>").alias("details"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").cast("string").alias("id"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """One feedback entry per event; every seventh has no rating."""
    number = F.col("event_id")
    return table(spark, folder, "events").select(
        number.cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("feedback_type"),
        F.when(number % 7 != 0, 1 + number % 5).cast("int").alias("rating"),
        F.col("props").alias("feedback_text"),
        F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("user_email"),
    )


def feature_requests(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("event_id")
    return table(spark, folder, "events").select(
        number.cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("request "), number).alias("feature_title"),
        F.when(number % 3 == 0, "High").when(number % 3 == 1, "Medium").otherwise("Low").alias("priority"),
        F.col("event_type").alias("category"),
        F.when(number % 4 == 0, "Completed").otherwise("Pending").alias("status"),
        F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("user_email"),
    )
