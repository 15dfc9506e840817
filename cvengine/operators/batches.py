"""Adding customers to a table and removing them, with checks of new records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_customers(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def remove_customers(existing: DataFrame, unwanted: DataFrame) -> DataFrame:
    return existing.join(unwanted.select("customer_id"), "customer_id", "left_anti")


def already_known(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return incoming.join(existing.select("customer_id"), "customer_id", "left_semi")


def not_yet_known(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return incoming.join(existing.select("customer_id"), "customer_id", "left_anti")


def check_new(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``violations``, the rules each incoming record breaks.

    Records without an id skip the lookup: they would all meet in one join partition.
    """
    records = incoming.withColumn("customer_id", F.trim("customer_id"))
    blank = F.coalesce(F.col("customer_id") == "", F.lit(True))
    known = existing.select("customer_id").distinct().withColumn("__known", F.lit(True))
    named = records.where(~blank).join(known, "customer_id", "left")
    looked_up = named.unionByName(records.where(blank).withColumn("__known", F.lit(None).cast("boolean")))
    age, first, last = F.col("age"), F.col("days_since_first_purchase"), F.col("days_since_last_purchase")
    rules = {
        "customer id is empty": blank,
        "customer id exists": F.col("__known"),
        "age outside 18 to 100": ~age.between(18, 100),
        "negative purchases": F.col("total_purchases") < 0,
        "order value not positive": F.col("avg_order_value") <= 0,
        "first purchase less than a day ago": first < 1,
        "negative days since last purchase": last < 0,
        "last purchase before first": last > first,
    }
    broken = F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()])
    return looked_up.withColumn("violations", F.array_compact(broken)).drop("__known")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)
