"""The runs a user starts: prepare, fit, score and report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.operators import bundle, cleaning, reports, scoring, split, strategies
from cvengine.operators.features import customer_features
from cvengine.operators.metrics import evaluate
from cvengine.operators.order import CELL_ROWS
from cvengine.operators.rollup import median_amounts, staged_rollup
from cvengine.plans.modeling import (
    ClvModel,
    TrainConfig,
    feature_columns,
    mark_test,
    model_input,
    save_model,
    train_models,
)
from cvengine.session import stage
from cvengine.sources.readers import read_table


class Fit(NamedTuple):
    """What a training run yields."""

    model: ClvModel
    leaderboard: DataFrame
    predictions: DataFrame
    insights: dict[str, DataFrame]
    importance: DataFrame


def clean(df: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Retail rows or customer summaries, told apart by their columns."""
    if {"quantity", "unit_price"} <= set(cleaning.retail_names(df.columns)):
        return cleaning.clean_transactions(df, cell_rows)
    cleaned = cleaning.clean_customers(df)
    if split.needs_split(cleaned):
        cleaning.require_retail(cleaned)
    return cleaned


def training_table(cleaned: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One staged row per customer with features, target and target percentile."""
    if split.needs_split(cleaned):
        cleaned = stage(cleaned, "transactions")
        window = split.split_window(cleaned)
        years = (int(window.start[:4]), int(window.end[:4]))
        past = split.feature_rows(cleaned, window)
        rolled = staged_rollup(past, years)
        features = customer_features(rolled, cell_rows=cell_rows)
        features = features.join(median_amounts(past, rolled, cell_rows), "customer_id", "left")
        future = split.future_value(split.target_rows(cleaned, window))
        table = split.attach_target(features, future)
    else:
        table = split.summary_target(cleaned)
    return split.with_target_percentile(stage(table, "training"))


def fit_pipeline(
    spark: SparkSession,
    source: str | DataFrame,
    config: TrainConfig | None = None,
    save_path: str | None = None,
    legacy_features: bool = False,
    on_ties: str = "raise",
    cell_rows: int = CELL_ROWS,
) -> Fit:
    """Read, clean, split, build features, train, then describe the held-out customers."""
    config = config or TrainConfig()
    table = training_table(clean(read_table(spark, source), cell_rows), cell_rows)
    columns = feature_columns(table, legacy_features)
    model = train_models(model_input(table, columns, "predicted_clv"), columns, config, cell_rows)
    held_out = mark_test(table, config).where("is_test").drop("is_test", "fold")
    actual = held_out.withColumnRenamed("predicted_clv", "actual_clv")
    predictions = stage(model.predict(actual), "held-out")
    predictions = stage(scoring.enrich(predictions, on_ties, cell_rows), "scored")
    pairs = predictions.select(
        "customer_id", F.col("actual_clv").alias("actual"), F.col("predicted_clv").alias("predicted")
    )
    insights = {
        "model_performance": evaluate(pairs, cell_rows),
        "segment_analysis": reports.insight_table(predictions, cell_rows=cell_rows),
        "revenue_impact": reports.revenue_impact(predictions),
    }
    if save_path:
        save_model(model, spark, save_path)
    return Fit(model, model.leaderboard(spark), predictions, insights, model.importance(spark))


def score(df: DataFrame, model: ClvModel, on_ties: str = "raise", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Predict and enrich customers; staged, ready for ``describe``."""
    predicted = stage(model.predict(df), "predicted")
    return stage(scoring.enrich(predicted, on_ties, cell_rows), "scored")


def describe(scored: DataFrame, model: ClvModel | None = None, cell_rows: int = CELL_ROWS) -> dict[str, DataFrame]:
    """Reports, lifetime metrics and recommendations."""
    importance = model.importance(scored.sparkSession) if model else None
    made = bundle.Bundle(scored, cell_rows=cell_rows)
    return {
        **bundle.reports(scored, importance, cell_rows, made),
        **bundle.lifetime_metrics(scored, cell_rows, made),
        "recommendations": strategies.recommendations(scored),
    }
