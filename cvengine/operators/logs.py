"""Summaries of the action log, feedback and feature requests.

``asof`` is the moment "recent" counts back from, by default the current time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine import fixed_values as fixed


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), "id")


def most_recent(log: DataFrame, count: int = fixed.LOG_KEEP) -> DataFrame:
    """The newest entries; each task keeps its own ``count`` before they are merged."""
    return newest_first(log).limit(count)


def within(asof: Column | None, hours: int) -> Column:
    moment = F.current_timestamp() if asof is None else asof
    return F.col("timestamp") > moment - F.make_dt_interval(F.lit(0), F.lit(hours))


def trailing(log: DataFrame, asof: Column | None, hours: int) -> DataFrame:
    return log.where(within(asof, hours))


def action_summary(actions: DataFrame, asof: Column | None = None) -> DataFrame:
    return actions.agg(
        F.count(F.lit(1)).alias("total_actions"), F.count_if(within(asof, 24)).alias("recent_actions")
    )


def popular_actions(actions: DataFrame, count: int = 5) -> DataFrame:
    counts = actions.groupBy("action").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "action").limit(count)


def feedback_summary(feedback: DataFrame, asof: Column | None = None) -> DataFrame:
    """Entries without a rating count as 0 in the average."""
    return feedback.agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.avg(F.coalesce("rating", F.lit(0))).alias("average_rating"),
        F.count_if(within(asof, 24 * 7)).alias("this_week"),
    )


def request_summary(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("status") == "Pending").alias("pending"),
        F.count_if(F.col("priority") == "High").alias("high_priority"),
    )


def _minute() -> Column:
    return F.date_format("timestamp", "yyyy-MM-dd HH:mm")


def feedback_display(feedback: DataFrame) -> DataFrame:
    return feedback.select(
        _minute().alias("Date"),
        F.col("feedback_type").alias("Type"),
        F.concat(F.col("rating").cast("string"), F.lit("/5")).alias("Rating"),
        F.col("user_email").alias("Email"),
        F.col("feedback_text").alias("Feedback"),
    )


def request_display(requests: DataFrame) -> DataFrame:
    return requests.select(
        _minute().alias("Date"),
        F.col("feature_title").alias("Title"),
        F.col("priority").alias("Priority"),
        F.col("category").alias("Category"),
        F.col("status").alias("Status"),
        F.col("user_email").alias("Email"),
    )
