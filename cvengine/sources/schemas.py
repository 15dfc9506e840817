"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

CUSTOMER = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("age", T.LongType()),
        T.StructField("total_purchases", T.LongType()),
        T.StructField("avg_order_value", T.DoubleType()),
        T.StructField("days_since_first_purchase", T.LongType()),
        T.StructField("days_since_last_purchase", T.LongType()),
        T.StructField("acquisition_channel", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("subscription_status", T.StringType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("feedback_type", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("feedback_text", T.StringType()),
        T.StructField("user_email", T.StringType()),
    ]
)

FEATURE_REQUEST = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in [
            "feature_title",
            "feature_description",
            "use_case",
            "additional_notes",
            "priority",
            "category",
            "user_email",
            "status",
            "id",
        ]
    ]
    + [T.StructField("timestamp", T.TimestampType())]
)

ACTION = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("action", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("session_id", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)
