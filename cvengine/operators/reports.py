"""Report tables over scored customers.

Functions take the enriched, staged frame. ``digits`` rounds half to even for display;
None leaves full precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine import fixed_values as fixed
from cvengine.functions.scalars import half_even, money_mean, money_sum
from cvengine.operators.binning import labelled_quantiles, quantile_edges
from cvengine.operators.order import (
    CELL_ROWS,
    grouped_medians,
    grouped_quantiles,
    not_after,
    quantiles,
    rows_at,
    values_at,
)
from cvengine.operators.scoring import high_risk, segment_number

CLV = "predicted_clv"


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: half_even(F.col(c), digits) for c in doubles})


def _all_labels(df: DataFrame, column: str, labels: list[str], counts: list[str]) -> DataFrame:
    """One row per label in order; labels without rows have count 0."""
    spark = df.sparkSession
    names = spark.createDataFrame([(s, i + 1) for i, s in enumerate(labels)], f"{column} string, sort_order int")
    full = names.join(df, column, "left")
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def _stats(column: str, kinds: list[str]) -> list[Column]:
    made = {
        "count": F.count(column),
        "sum": money_sum(F.col(column)),
        "mean": F.avg(column),
        "std": F.stddev_samp(column),
        "min": F.min(column),
        "max": F.max(column),
    }
    if column == CLV:
        made["mean"] = money_mean(F.col(column))
    return [made[k].alias(f"{column}_{k}") for k in kinds]


def _by_segment(
    scored: DataFrame, spec: dict[str, list[str]], medians: list[str], digits: int | None, cell_rows: int
) -> DataFrame:
    group = "customer_segment"
    aggregates = [c for column, kinds in spec.items() for c in _stats(column, kinds)]
    table = scored.groupBy(group).agg(*aggregates)
    if medians:
        middle = grouped_medians(scored.where(F.col(group).isNotNull()), [group], medians, cell_rows)
        table = table.join(middle, group)
    counts = [f"{c}_count" for c, kinds in spec.items() if "count" in kinds]
    return _rounded(_all_labels(table, group, fixed.SEGMENTS, counts), digits)


def segment_summary(scored: DataFrame, digits: int | None = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    return _by_segment(
        scored,
        {CLV: ["count", "mean", "std", "min", "max"], "churn_risk": ["mean"], "percentile_rank": ["mean"]},
        [CLV, "churn_risk", "percentile_rank"],
        digits,
        cell_rows,
    )


def segment_metrics(scored: DataFrame, digits: int | None = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    return _by_segment(
        scored,
        {CLV: ["count", "sum", "mean", "std"], "churn_risk": ["mean"], "percentile_rank": ["mean"]},
        [CLV],
        digits,
        cell_rows,
    )


def segment_comparison(scored: DataFrame, digits: int | None = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    return _by_segment(
        scored,
        {CLV: ["count", "mean", "sum"], "churn_risk": ["mean"], "percentile_rank": ["mean"]},
        [CLV],
        digits,
        cell_rows,
    )


def segment_revenue(scored: DataFrame, digits: int | None = 2) -> DataFrame:
    """Revenue per segment and its share of the total, in percent."""
    per_segment = scored.groupBy("customer_segment").agg(money_sum(F.col(CLV)).alias(CLV))
    total = F.broadcast(scored.agg(money_sum(F.col(CLV)).alias("total")))
    table = _all_labels(per_segment, "customer_segment", fixed.SEGMENTS, [CLV]).crossJoin(total)
    share = F.try_divide(F.col(CLV), F.col("total")) * 100
    return _rounded(table.withColumn("percentage", share).drop("total"), digits)


def insight_table(scored: DataFrame, digits: int | None = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Predicted against actual value per segment; needs ``actual_clv``."""
    return _by_segment(
        scored,
        {CLV: ["count", "mean", "std"], "actual_clv": ["mean", "std"]},
        [CLV, "actual_clv"],
        digits,
        cell_rows,
    )


def revenue_impact(scored: DataFrame) -> DataFrame:
    top = F.col("customer_segment") == fixed.SEGMENTS[-1]
    total, high = money_sum(F.col(CLV)), F.coalesce(money_sum(F.when(top, F.col(CLV))), F.lit(0.0))
    return scored.agg(total.alias("total_predicted_clv"), high.alias("high_value_contribution")).withColumn(
        "high_value_percentage",
        F.when(
            F.col("total_predicted_clv") > 0, F.col("high_value_contribution") / F.col("total_predicted_clv") * 100
        ).otherwise(F.lit(0.0)),
    )


PORTFOLIO_QUANTILES = {
    "median_clv": (1, 2),
    "clv_25th_percentile": (1, 4),
    "clv_75th_percentile": (3, 4),
    "clv_90th_percentile": (9, 10),
    "clv_95th_percentile": (95, 100),
}


def portfolio(scored: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row: size, total, mean, deviation and quantiles of the predicted value."""
    found = quantiles(scored, CLV, list(PORTFOLIO_QUANTILES.values()), cell_rows=cell_rows)
    return scored.agg(
        F.count(F.lit(1)).alias("total_customers"),
        money_sum(F.col(CLV)).alias("total_clv"),
        money_mean(F.col(CLV)).alias("avg_clv"),
        F.stddev_samp(CLV).alias("clv_std"),
    ).withColumns({name: F.lit(v).cast("double") for name, v in zip(PORTFOLIO_QUANTILES, found)})


def tier_table(
    scored: DataFrame, digits: int | None = 2, on_ties: str = "raise", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Quartile tiers with size, total, mean and average risk."""
    edges = quantile_edges(scored, CLV, len(fixed.TIERS), cell_rows=cell_rows)
    tier = labelled_quantiles(F.col(CLV), edges, fixed.TIERS, on_ties)
    table = scored.groupBy(tier.alias("tier")).agg(
        *_stats(CLV, ["count", "sum", "mean"]), F.avg("churn_risk").alias("churn_risk_mean")
    )
    return _rounded(_all_labels(table, "tier", fixed.TIERS, [f"{CLV}_count"]), digits)


def risk_exposure(scored: DataFrame) -> DataFrame:
    """Number, share and value of customers at high risk."""
    risky = F.col("churn_risk") > fixed.HIGH_RISK
    return scored.agg(
        F.count_if(risky).alias("high_risk_count"),
        (F.try_divide(F.count_if(risky), F.count(F.lit(1))) * 100).alias("high_risk_percentage"),
        F.coalesce(money_sum(F.when(risky, F.col(CLV))), F.lit(0.0)).alias("high_risk_clv_value"),
    )


def revenue_concentration(scored: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Value held by the top tenth of customers.

    Only the smallest value inside the tenth is looked up; customers tied with it fill the
    remaining places, whoever they are.
    """
    rows = scored.agg(F.count(CLV)).first()[0]
    places = int(rows * fixed.TOP_SHARE)
    if places:
        last = values_at(scored, CLV, [rows - places], rows, cell_rows)[rows - places]
        above = F.col(CLV) > F.lit(last)
        top = F.coalesce(money_sum(F.when(above, F.col(CLV))), F.lit(0.0)) + F.lit(last) * (F.lit(places) - F.count_if(above))
    else:
        top = F.lit(0.0)
    return scored.agg(top.alias("top_10_percent_revenue"), money_sum(F.col(CLV)).alias("total_clv")).select(
        "top_10_percent_revenue",
        (F.try_divide("top_10_percent_revenue", "total_clv") * 100).alias("top_10_percent_share"),
    )


def readings(concentration: DataFrame, risk: DataFrame) -> DataFrame:
    """Verdicts on a row of concentration and a row of exposure."""
    share, risky = F.col("top_10_percent_share"), F.col("high_risk_percentage")
    return concentration.crossJoin(F.broadcast(risk)).select(
        share,
        F.when(share > 50, "concentrated").otherwise("healthy").alias("revenue_verdict"),
        risky,
        F.when(risky > 30, "high").when(risky > 15, "moderate").otherwise("low").alias("churn_verdict"),
    )


def verdicts(scored: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Readings of concentration and risk."""
    return readings(revenue_concentration(scored, cell_rows), risk_exposure(scored))


def channel_segments(scored: DataFrame) -> DataFrame:
    return scored.groupBy("acquisition_channel", "customer_segment").agg(F.count(F.lit(1)).alias("count"))


def mean_value_by(scored: DataFrame, column: str) -> DataFrame:
    """Mean predicted value per location or subscription status."""
    return scored.groupBy(column).agg(money_mean(F.col(CLV)).alias(CLV))


def segment_counts(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "customer_segment")


def score_tiles(scored: DataFrame) -> DataFrame:
    top = F.col("customer_segment") == fixed.SEGMENTS[-1]
    return scored.agg(
        money_mean(F.col(CLV)).alias("avg_clv"),
        money_sum(F.col(CLV)).alias("total_clv"),
        F.count_if(top).alias("high_value_customers"),
        F.avg("churn_risk").alias("avg_churn_risk"),
    )


def input_tiles(customers: DataFrame) -> DataFrame:
    """Row count, completeness and two averages, in one pass."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in customers.columns), F.lit(0))
    rows = F.count(F.lit(1))
    made = [
        rows.alias("total_customers"),
        (100 - F.try_divide(missing, rows * len(customers.columns)) * 100).alias("data_completeness"),
    ]
    for column, name in (("total_purchases", "avg_purchases"), ("avg_order_value", "avg_order_value")):
        value = F.avg(column) if column in customers.columns else F.lit(0.0)
        made.append(value.alias(name))
    return customers.agg(*made)


DISPLAY = ["customer_id", CLV, "customer_segment", "churn_risk", "percentile_rank"]


def _display(df: DataFrame, count: int, rounded: bool) -> DataFrame:
    top = df.select(*DISPLAY).orderBy(F.desc_nulls_last(CLV), "customer_id").limit(count)
    if not rounded:
        return top
    return top.select(
        "customer_id",
        half_even(F.col(CLV), 2).alias(CLV),
        "customer_segment",
        half_even(F.col("churn_risk") * 100, 1).alias("churn_risk_percent"),
        half_even(F.col("percentile_rank"), 1).alias("percentile_rank"),
    )


def top_customers(scored: DataFrame, count: int = 10, rounded: bool = True) -> DataFrame:
    return _display(scored, count, rounded)


def top_tenth(scored: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The tenth of the customers with the highest value; ties go to the smaller id."""
    keyed = scored.withColumn("__down", -F.col(CLV))
    rows = scored.count()
    places = int(rows * fixed.TOP_SHARE)
    if not places:
        return scored.limit(0)
    keys = ["__down", "customer_id"]
    last = rows_at(keyed, keys, [places - 1], rows, cell_rows)[places - 1]
    return keyed.where(not_after(keys, last)).drop("__down")


def top_high_risk(scored: DataFrame, count: int = 10, rounded: bool = True) -> DataFrame:
    return _display(high_risk(scored), count, rounded)


def histogram(scored: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins over the value range; the last bin is closed."""
    low, high = scored.agg(F.min(column), F.max(column)).first()
    if low is None:
        return scored.sparkSession.createDataFrame([], "bin int, lower double, count bigint")
    width = (high - low) / bins
    at = F.lit(0) if width == 0 else F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    counts = scored.where(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bin"))
    return counts.agg(F.count(F.lit(1)).alias("count")).withColumn("lower", F.lit(low) + F.col("bin") * F.lit(width))


def box_plot(scored: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Five-number summary of the predicted value per segment."""
    quartiles = {"q1": (1, 4), "median": (1, 2), "q3": (3, 4)}
    inner = grouped_quantiles(scored, ["customer_segment"], CLV, quartiles, cell_rows=cell_rows)
    ends = scored.groupBy("customer_segment").agg(F.min(CLV).alias("low"), F.max(CLV).alias("high"))
    return ends.join(inner, "customer_segment")


SCATTER_AXES = ["churn_risk", "age", "total_purchases", "avg_order_value"]


def scatter_points(scored: DataFrame) -> DataFrame:
    """Value against risk, age, purchases and order value, with segment and rank."""
    axes = [c for c in SCATTER_AXES if c in scored.columns]
    return scored.select("customer_id", CLV, *axes, "customer_segment", "percentile_rank")


def scatter_grid(scored: DataFrame, axis: str, cells: int = 100) -> DataFrame:
    """The same cloud as counts on a grid, of bounded size for any number of customers."""
    x0, x1, y0, y1 = scored.agg(F.min(axis), F.max(axis), F.min(CLV), F.max(CLV)).first()

    def place(column: str, low: float | None, high: float | None) -> Column:
        if low is None or low == high:
            return F.lit(0)
        step = (high - low) / cells
        return F.least(F.floor((F.col(column) - low) / step), F.lit(cells - 1)).cast("int")

    grid = scored.where(F.col(axis).isNotNull() & F.col(CLV).isNotNull())
    return grid.groupBy("customer_segment", place(axis, x0, x1).alias("x"), place(CLV, y0, y1).alias("y")).agg(
        F.count(F.lit(1)).alias("count")
    )


def band_sample(scored: DataFrame, count: int = 50) -> DataFrame:
    """A repeatable sample of customers with their bands, by value."""
    columns = ["customer_id", CLV, "confidence_lower", "confidence_upper"]
    return scored.select(*columns).orderBy(F.md5("customer_id"), "customer_id").limit(count).orderBy(CLV)


def filter_choices(scored: DataFrame, column: str = "customer_segment") -> DataFrame:
    return scored.select(column).distinct()


def preview(df: DataFrame, count: int = 5) -> DataFrame:
    return df.limit(count)
