"""All grouped report tables from one pass: an aggregate over grouping sets, split afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvengine import fixed_values as fixed
from cvengine.functions.scalars import money_mean, money_sum
from cvengine.operators import reports as single
from cvengine.operators.binning import labelled_quantiles
from cvengine.operators.order import CELL_ROWS, column_quantiles, grouped_medians
from cvengine.operators.reports import CLV, PORTFOLIO_QUANTILES, SCATTER_AXES, _all_labels, _rounded
from cvengine.session import stage

#: Histograms: column and number of bins.
HISTOGRAMS = {"clv_distribution": (CLV, 20), "churn_distribution": ("churn_risk", 15), "percentile_distribution": ("percentile_rank", 20)}
GRID = 100
SEGMENT = "customer_segment"


def _cell(column: str, low: float | None, high: float | None, cells: int) -> Column:
    """Number of the equal-width cell; a constant column is all in cell 0."""
    if low is None or low == high:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    step = (high - low) / cells
    return F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(cells - 1)).cast("int")


class Bundle:
    """The grouped tables of scored customers. Three passes over ``scored``, whatever the number of tables:

    * ends of all binned columns and quantiles of the predicted value;
    * one aggregate over the grouping sets of all tables, which is staged;
    * medians per segment.

    Rows equal those of the functions of the same tables in ``reports``.
    """

    def __init__(self, scored: DataFrame, on_ties: str = "raise", cell_rows: int = CELL_ROWS) -> None:
        self.columns = set(scored.columns)
        self.axes = ["churn_risk", *[c for c in SCATTER_AXES[1:] if c in self.columns]]
        binned = list(dict.fromkeys([CLV, "churn_risk", "percentile_rank", *self.axes]))
        self._ends(scored, binned, cell_rows)
        tiers = [self.quantiles[k, 4] for k in range(5)]
        keys = {
            "segment": F.col(SEGMENT),
            "tier": labelled_quantiles(F.col(CLV), tiers, fixed.TIERS, on_ties) if tiers[0] is not None else F.lit(None).cast("string"),
            **{name: F.col(name) for name in ("acquisition_channel", "location", "subscription_status") if name in self.columns},
            **{name: _cell(column, *self.ends[column], bins) for name, (column, bins) in HISTOGRAMS.items()},
            **{f"x_{axis}": _cell(axis, *self.ends[axis], GRID) for axis in self.axes},
            "y": _cell(CLV, *self.ends[CLV], GRID),
        }
        sets = {name: [name] for name in keys if name != "y" and not name.startswith("x_")}
        if "acquisition_channel" in keys:
            sets["channel_segment"] = ["acquisition_channel", "segment"]
        sets |= {f"grid_{axis}": ["segment", f"x_{axis}", "y"] for axis in self.axes}
        sets["all"] = []
        self.keys, self.sets = list(keys), sets
        measures = [CLV, "churn_risk", "percentile_rank"]
        named = scored.select(*[value.alias(f"k_{name}") for name, value in keys.items()], *measures)
        grouped = named.groupingSets([[F.col(f"k_{k}") for k in members] for members in sets.values()], *[F.col(f"k_{k}") for k in keys])
        risky = F.col("churn_risk") > fixed.HIGH_RISK
        cube = grouped.agg(
            F.grouping_id().alias("set"),
            F.count(F.lit(1)).alias("rows"),
            F.count(CLV).alias("count"),
            money_sum(F.col(CLV)).alias("sum"),
            money_mean(F.col(CLV)).alias("mean"),
            F.stddev_samp(CLV).alias("std"),
            F.min(CLV).alias("min"),
            F.max(CLV).alias("max"),
            F.avg("churn_risk").alias("churn"),
            F.avg("percentile_rank").alias("rank"),
            F.count_if(risky).alias("risky"),
            F.coalesce(money_sum(F.when(risky, F.col(CLV))), F.lit(0.0)).alias("risky_sum"),
        )
        self.cube = stage(cube, "report-cube")
        inner = grouped_medians(scored.where(F.col(SEGMENT).isNotNull()), [SEGMENT], measures, cell_rows)
        self.medians = stage(inner, "segment-medians")

    def _ends(self, scored: DataFrame, binned: list[str], cell_rows: int) -> None:
        """Least and greatest value of each binned column, and quantiles of the predicted value."""
        fractions = sorted({*[(k, 4) for k in range(5)], *PORTFOLIO_QUANTILES.values()})
        ends = [f(c).cast("double").alias(f"{f.__name__}_{c}") for c in binned for f in (F.min, F.max)]
        if scored.count() <= cell_rows:
            row = scored.agg(*ends, F.percentile(CLV, [k / q for k, q in fractions]).alias("at")).first()
            at = row["at"] or [None] * len(fractions)
        else:
            row = scored.agg(*ends).first()
            at = column_quantiles(scored, [CLV], fractions, cell_rows)[CLV]
        self.ends = {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in binned}
        self.quantiles = dict(zip(fractions, at))

    def part(self, name: str, *columns: Column) -> DataFrame:
        """``columns`` of the groups of one set."""
        members = self.sets[name]
        number = sum(1 << (len(self.keys) - 1 - i) for i, k in enumerate(self.keys) if k not in members)
        return self.cube.where(F.col("set") == number).select(*columns)

    def _segments(self, measures: dict[str, str], medians: list[str], digits: int | None, counts: list[str]) -> DataFrame:
        table = self.part("segment", F.col("k_segment").alias(SEGMENT), *[F.col(m).alias(name) for name, m in measures.items()])
        if medians:
            table = table.join(self.medians.select(SEGMENT, *[f"{c}_median" for c in medians]), SEGMENT)
        return _rounded(_all_labels(table, SEGMENT, fixed.SEGMENTS, counts), digits)

    def segment_summary(self, digits: int | None = 2) -> DataFrame:
        measures = {f"{CLV}_{m}": m for m in ("count", "mean", "std", "min", "max")} | {"churn_risk_mean": "churn", "percentile_rank_mean": "rank"}
        return self._segments(measures, [CLV, "churn_risk", "percentile_rank"], digits, [f"{CLV}_count"])

    def segment_metrics(self, digits: int | None = 2) -> DataFrame:
        measures = {f"{CLV}_{m}": m for m in ("count", "sum", "mean", "std")} | {"churn_risk_mean": "churn", "percentile_rank_mean": "rank"}
        return self._segments(measures, [CLV], digits, [f"{CLV}_count"])

    def segment_comparison(self, digits: int | None = 2) -> DataFrame:
        measures = {f"{CLV}_{m}": m for m in ("count", "mean", "sum")} | {"churn_risk_mean": "churn", "percentile_rank_mean": "rank"}
        return self._segments(measures, [CLV], digits, [f"{CLV}_count"])

    def segment_revenue(self, digits: int | None = 2) -> DataFrame:
        total = F.broadcast(self.part("all", F.col("sum").alias("total")))
        table = self._segments({CLV: "sum"}, [], None, [CLV]).crossJoin(total)
        return _rounded(table.withColumn("percentage", F.try_divide(F.col(CLV), F.col("total")) * 100).drop("total"), digits)

    def segment_counts(self) -> DataFrame:
        counts = self.part("segment", F.col("k_segment").alias(SEGMENT), F.col("rows").alias("count"))
        return counts.orderBy(F.desc("count"), SEGMENT)

    def tier_table(self, digits: int | None = 2) -> DataFrame:
        table = self.part("tier", F.col("k_tier").alias("tier"), *[F.col(m).alias(f"{CLV}_{m}") for m in ("count", "sum", "mean")], F.col("churn").alias("churn_risk_mean"))
        return _rounded(_all_labels(table, "tier", fixed.TIERS, [f"{CLV}_count"]), digits)

    def channel_segments(self) -> DataFrame:
        keys = [F.col("k_acquisition_channel").alias("acquisition_channel"), F.col("k_segment").alias(SEGMENT)]
        return self.part("channel_segment", *keys, F.col("rows").alias("count"))

    def mean_value_by(self, column: str) -> DataFrame:
        return self.part(column, F.col(f"k_{column}").alias(column), F.col("mean").alias(CLV))

    def histogram(self, name: str) -> DataFrame:
        column, bins = HISTOGRAMS[name]
        low, high = self.ends[column]
        found = self.part(name, F.col(f"k_{name}").alias("bin"), F.col("rows").alias("count")).where(F.col("bin").isNotNull())
        return found.withColumn("lower", F.lit(low or 0.0) + F.col("bin") * F.lit(((high or 0.0) - (low or 0.0)) / bins))

    def scatter_grid(self, axis: str) -> DataFrame:
        cells = [F.col("k_segment").alias(SEGMENT), F.col(f"k_x_{axis}").alias("x"), F.col("k_y").alias("y")]
        return self.part(f"grid_{axis}", *cells, F.col("rows").alias("count")).where("x is not null and y is not null")

    def portfolio(self) -> DataFrame:
        figures = {"total_customers": "rows", "total_clv": "sum", "avg_clv": "mean", "clv_std": "std"}
        found = self.part("all", *[F.col(m).alias(name) for name, m in figures.items()])
        return found.withColumns({name: F.lit(self.quantiles[f]).cast("double") for name, f in PORTFOLIO_QUANTILES.items()})

    def risk_exposure(self) -> DataFrame:
        share = (F.try_divide("risky", "rows") * 100).alias("high_risk_percentage")
        return self.part("all", F.col("risky").alias("high_risk_count"), share, F.col("risky_sum").alias("high_risk_clv_value"))


def reports(scored: DataFrame, importance: DataFrame | None = None, cell_rows: int = CELL_ROWS, bundle: Bundle | None = None) -> dict[str, DataFrame]:
    """Every report table the columns allow; the grouped ones share the passes of a ``Bundle``."""
    made = bundle or Bundle(scored, on_ties="merge", cell_rows=cell_rows)
    tables = {
        **{name: made.histogram(name) for name in HISTOGRAMS},
        "customer_segments": made.segment_counts(),
        "clv_vs_churn": made.scatter_grid("churn_risk"),
        "segment_boxplot": single.box_plot(scored, cell_rows),
        "risk_reward_matrix": single.scatter_points(scored),
        "top_customers": single.top_customers(scored),
        "high_risk_customers": single.top_high_risk(scored),
        "summary_stats": made.segment_summary(),
        "segment_comparison": made.segment_comparison(),
        "segment_revenue": made.segment_revenue(),
    }
    if importance is not None:
        tables["feature_importance"] = importance.orderBy(F.desc("importance"), "feature").limit(10)
    for axis in made.axes[1:]:
        tables[f"{axis}_vs_clv"] = made.scatter_grid(axis)
    if "acquisition_channel" in scored.columns:
        tables["channel_segment"] = made.channel_segments()
    for column in ("location", "subscription_status"):
        if column in scored.columns:
            tables[f"{column}_clv"] = made.mean_value_by(column)
    if "confidence_lower" in scored.columns and "confidence_upper" in scored.columns:
        tables["confidence_intervals"] = single.band_sample(scored)
    return tables


def lifetime_metrics(scored: DataFrame, cell_rows: int = CELL_ROWS, bundle: Bundle | None = None, on_ties: str = "raise") -> dict[str, DataFrame]:
    """Portfolio, segments, tiers, risk, concentration and their readings."""
    made = bundle or Bundle(scored, on_ties, cell_rows)
    concentration = stage(single.revenue_concentration(scored, cell_rows), "concentration")
    risk = made.risk_exposure()
    return {
        "portfolio": made.portfolio(),
        "segment_analysis": made.segment_metrics(),
        "tier_analysis": made.tier_table(),
        "risk": risk,
        "concentration": concentration,
        "verdicts": single.readings(concentration, risk),
    }
