"""Enrichment of scored customers: segment, churn risk, percentile rank, band."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine import fixed_values as fixed
from cvengine.operators.binning import labelled_quantiles, quantile_edges
from cvengine.operators.order import CELL_ROWS, percent_rank


class ClvStats(NamedTuple):
    """Whole-column figures that every row is compared with."""

    rows: int
    largest: float | None
    deviation: float | None
    edges: list[float | None]


def clv_stats(scored: DataFrame, cell_rows: int = CELL_ROWS) -> ClvStats:
    clv = "predicted_clv"
    rows, largest, deviation = scored.agg(F.count(clv), F.max(clv), F.stddev_samp(clv)).first()
    return ClvStats(rows, largest, deviation, quantile_edges(scored, clv, len(fixed.SEGMENTS), rows, cell_rows))


def segment(edges: list[float | None], on_ties: str = "raise") -> Column:
    return labelled_quantiles(F.col("predicted_clv"), edges, fixed.SEGMENTS, on_ties)


def segment_number(name: Column) -> Column:
    """Position of a segment in the fixed order, lowest value first."""
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEGMENTS]), name).cast("int")


def churn_risk(largest: float | None) -> Column:
    return 1 - F.try_divide(F.col("predicted_clv"), F.lit(largest).cast("double"))


def band(deviation: float | None, side: int) -> Column:
    return F.col("predicted_clv") + F.lit(side * fixed.BAND_WIDTH) * F.lit(deviation).cast("double")


def discounted(value: Column, months: int = 12, yearly_rate: float = 0.05) -> Column:
    """An extension: ``value`` spread evenly over ``months``, each month's part discounted to today."""
    if months < 1 or yearly_rate <= -1:
        raise ValueError("months must be positive and the rate above -1")
    return value * F.lit(sum((1 + yearly_rate) ** (-m / 12) for m in range(1, months + 1)) / months)


def enrich(scored: DataFrame, on_ties: str = "raise", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add segment, risk, rank and band to rows with ``customer_id`` and ``predicted_clv``.

    ``scored`` should be staged: whole-column figures take passes over that one column.
    """
    stats = clv_stats(scored, cell_rows)
    ranked = percent_rank(scored, "predicted_clv", "percentile_rank", ["customer_id"], cell_rows, stats.rows)
    return ranked.withColumns(
        {
            "customer_segment": segment(stats.edges, on_ties),
            "churn_risk": churn_risk(stats.largest),
            "confidence_lower": band(stats.deviation, -1),
            "confidence_upper": band(stats.deviation, 1),
        }
    )


def filter_results(
    scored: DataFrame, segments: list[str] | None = None, min_clv: float = 0.0, max_churn_risk: float = 1.0
) -> DataFrame:
    kept = scored.where((F.col("predicted_clv") >= min_clv) & (F.col("churn_risk") <= max_churn_risk))
    return kept if segments is None else kept.where(F.col("customer_segment").isin(segments))


def high_risk(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("churn_risk") > fixed.HIGH_RISK)
