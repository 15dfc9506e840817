"""Action quadrants: segment value against churn risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine import fixed_values as fixed
from cvengine.functions.scalars import money_mean


def strategy() -> Column:
    """The quadrant of a customer, NULL for the middle segments."""
    segment = F.col("customer_segment")
    calm, risky = F.col("churn_risk") < fixed.QUADRANT_RISK, F.col("churn_risk") >= fixed.QUADRANT_RISK
    high, low = segment == fixed.SEGMENTS[-1], segment.isin(fixed.SEGMENTS[:2])
    keep, rescue, grow, win_back = fixed.STRATEGY_ACTIONS
    return F.when(high & calm, keep).when(high & risky, rescue).when(low & calm, grow).when(low & risky, win_back)


def with_strategy(scored: DataFrame) -> DataFrame:
    return scored.withColumn("strategy", strategy())


def recommendations(scored: DataFrame) -> DataFrame:
    """Size, mean value and actions of each quadrant that has customers, in one pass."""
    actions = F.create_map(
        *[c for name, todo in fixed.STRATEGY_ACTIONS.items() for c in (F.lit(name), F.array(*map(F.lit, todo)))]
    )
    quadrants = with_strategy(scored).where(F.col("strategy").isNotNull()).groupBy("strategy")
    return quadrants.agg(
        F.count(F.lit(1)).alias("count"), money_mean(F.col("predicted_clv")).alias("avg_clv")
    ).withColumn("actions", actions[F.col("strategy")])
