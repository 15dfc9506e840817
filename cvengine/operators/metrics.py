"""Regression and ranking metrics of (customer_id, actual, predicted) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine import fixed_values as fixed
from cvengine.operators.order import CELL_ROWS, average_rank, not_after, rows_at


def _error_measures() -> dict[str, Column]:
    actual, predicted = F.col("actual"), F.col("predicted")
    error = actual - predicted
    residual = F.sum(error * error)
    spread = F.var_pop(actual) * F.count(actual)
    return {
        "mse": F.avg(error * error),
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": F.coalesce(1 - F.try_divide(residual, spread), F.when(residual == 0, 1.0).otherwise(0.0)),
        "mape": F.avg(F.when(actual > 0, F.abs(error) / actual)),
    }


def fit_quality(pairs: DataFrame) -> DataFrame:
    """Error measures in one aggregate. MAPE covers positive actuals and is NULL without any."""
    return pairs.agg(*[c.alias(name) for name, c in _error_measures().items()])


def top_overlap(pairs: DataFrame, rows: int, cell_rows: int = CELL_ROWS) -> Column:
    """Share of the top tenth by actual value that is also in the top tenth by prediction.

    Membership is a comparison with the last customer of each tenth, so the two sets meet
    row by row without a join. Ties go to the smaller id.
    """
    if rows <= 10:
        return F.lit(0.0)
    places = max(1, int(rows * fixed.TOP_SHARE))
    member = []
    for column in ("actual", "predicted"):
        down = f"__down_{column}"
        keyed = pairs.select((-F.col(column)).alias(down), "customer_id")
        bound = rows_at(keyed, [down, "customer_id"], [places - 1], rows, cell_rows)[places - 1]
        member.append((down, -F.col(column), bound))
    inside = [
        (value < F.lit(bound[0])) | ((value == F.lit(bound[0])) & not_after(["customer_id"], bound[1:]))
        for _, value, bound in member
    ]
    return F.count_if(inside[0] & inside[1]) / F.lit(float(places))


def evaluate(pairs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All metrics as one row; ``pairs`` should be staged."""
    rows = pairs.count()
    ranked = average_rank(pairs, "actual", "__rank_actual", ["customer_id"], cell_rows, rows)
    ranked = average_rank(ranked, "predicted", "__rank_predicted", ["customer_id"], cell_rows, rows)
    if rows > 1:  # NULL where one side is constant
        spread = F.stddev_pop("__rank_actual") * F.stddev_pop("__rank_predicted")
        correlation = F.try_divide(F.covar_pop("__rank_actual", "__rank_predicted"), spread)
    else:
        correlation = F.lit(0.0)
    return ranked.agg(
        *[c.alias(name) for name, c in _error_measures().items()],
        correlation.alias("ranking_correlation"),
        top_overlap(pairs, rows, cell_rows).alias("top_10_precision"),
    )
