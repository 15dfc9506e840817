"""Behavioural features on top of the rollup, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvengine import fixed_values as fixed
from cvengine.functions.scalars import whole_days
from cvengine.operators.binning import quantile_edges, quantile_score, rank_score
from cvengine.operators.order import CELL_ROWS
from cvengine.operators.rollup import SEASON_ORDER

SCORES = list(range(1, fixed.RFM_CLASSES + 1))


def behaviour(rollup: DataFrame, reference_date: Column) -> DataFrame:
    """Lifespan, recency, rhythm, diversity and spending ratios."""
    count, days = F.col("total_transactions"), F.col("customer_lifespan")
    return (
        rollup.withColumns(
            {
                "customer_lifespan": whole_days(F.col("first_purchase"), F.col("last_purchase")),
                "days_since_last_purchase": whole_days(F.col("last_purchase"), reference_date),
            }
        )
        .withColumns(
            {
                "avg_days_between_purchases": days / F.greatest(count - 1, F.lit(1)),
                "purchase_frequency": count / F.greatest(days + 1, F.lit(1)),
                "purchase_velocity": count / F.greatest(days, F.lit(1)),
                "product_diversity_ratio": F.try_divide(F.col("unique_products"), count),
                "spending_consistency": F.try_divide(
                    F.lit(1.0),
                    1 + F.col("std_order_value") / F.greatest(F.col("avg_order_value"), F.lit(0.01)),
                ),
                "revenue_per_transaction": F.try_divide(F.col("total_revenue"), count),
                "revenue_growth_potential": F.try_divide(F.col("max_order_value"), F.col("avg_order_value")),
                "recency": F.col("days_since_last_purchase"),
                "frequency": count,
                "monetary": F.col("total_revenue"),
            }
        )
    )


def churn_signals(features: DataFrame) -> DataFrame:
    """Whether the silence exceeds twice the usual gap, and how far along it is."""
    threshold = F.col("avg_days_between_purchases") * fixed.CHURN_MULTIPLIER
    silent = F.col("days_since_last_purchase")
    return features.withColumns(
        {
            "churn_flag": (silent > threshold).cast("int"),
            "churn_probability": F.least(silent / F.greatest(threshold, F.lit(1.0)), F.lit(1.0)),
        }
    )


def encode_labels(df: DataFrame, column: str, domain: list[str], out: str) -> DataFrame:
    """Dense index of the labels that occur, in sorted order. ``domain`` lists all labels."""
    seen = df.agg(*[F.max(F.col(column) == label).alias(str(i)) for i, label in enumerate(domain)])
    flags = [F.col(str(i)).alias(f"__seen{i}") for i in range(len(domain))]
    coded = df.crossJoin(F.broadcast(seen.select(*flags)))
    index = F.lit(None).cast("int")
    below = F.lit(0)
    for i, label in sorted(enumerate(domain), key=lambda pair: pair[1]):
        index = F.when(F.col(column) == label, below).otherwise(index)
        below = below + F.coalesce(F.col(f"__seen{i}").cast("int"), F.lit(0))
    return coded.withColumn(out, index).drop(*[f"__seen{i}" for i in range(len(domain))])


def rfm_scores(features: DataFrame, recency_of: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Quintile scores. ``recency_of`` holds the same customers and is cheap to scan."""
    slim = recency_of.select(
        "customer_id",
        F.col("recency").cast("double").alias("recency"),
        F.col("frequency").cast("bigint").alias("frequency"),
        F.col("monetary").cast("double").alias("monetary"),
    )
    rows = slim.count()
    recency = quantile_edges(slim, "recency", fixed.RFM_CLASSES, rows, cell_rows)
    monetary = quantile_edges(slim, "monetary", fixed.RFM_CLASSES, rows, cell_rows)
    by_frequency = rank_score(slim, ["frequency", "customer_id"], SCORES, rows, cell_rows)
    return features.withColumns(
        {
            "recency_score": quantile_score(F.col("recency"), recency, SCORES[::-1]),
            "frequency_score": by_frequency,
            "monetary_score": quantile_score(F.col("monetary"), monetary, SCORES),
        }
    )


def zero_missing_numbers(df: DataFrame) -> DataFrame:
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, numeric)


def customer_features(rollup: DataFrame, reference_date: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rollup with all derived features. It should be staged, as edges take passes over it.

    Days count back from ``reference_date``, by default the newest purchase.
    """
    if reference_date is None:
        reference_date = rollup.agg(F.max("last_purchase").cast("string")).first()[0]
    reference = F.lit(reference_date).cast(rollup.schema["last_purchase"].dataType)
    features = behaviour(rollup, reference)
    scored = churn_signals(rfm_scores(features, features, cell_rows))
    return zero_missing_numbers(encode_labels(scored, "preferred_season", SEASON_ORDER, "season_encoded"))
