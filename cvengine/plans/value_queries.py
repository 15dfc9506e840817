"""Queries over features, ranks, scores, reports and models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine import fixed_values as fixed
from cvengine.functions import scalars
from cvengine.operators import binning, bundle, features, metrics, order, reports, scoring, split, strategies
from cvengine.operators.rollup import MODES, customer_rollup, staged_rollup
from cvengine.plans import modeling, pipeline
from cvengine.plans.check_sql import CLV, CUST, FEATURES, LABELS, PAIRS, ROLL, SCORED, TXN, money, r6
from cvengine.plans.registry import day, query, six_digits
from cvengine.session import new_path, stage
from cvengine.sources import tables

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def windowed(spark: SparkSession, folder: str) -> tuple[DataFrame, split.Window]:
    """The transactions of the windows, joined once and staged for every pass over them.

    The bounds come from the orders alone, so that they reach the scan before the join. Should the newest orders
    have no lines, the windows lie earlier and the rows are read again from there.
    """
    orders = tables.table(spark, folder, "orders").select(F.col("o_orderdate").alias("invoice_date"))
    expected = split.split_window(orders)
    rows = stage(tables.transactions(spark, folder, since=expected.start), "transactions")
    window = split.split_window(rows)
    if window.newest != expected.newest:
        rows = stage(tables.transactions(spark, folder, since=window.start), "transactions")
    return rows, window


def rolled_up(spark: SparkSession, folder: str) -> DataFrame:
    """The staged rollup of the feature window, without the median."""
    transactions, window = windowed(spark, folder)
    years = (int(window.start[:4]), int(window.end[:4]))
    return staged_rollup(split.feature_rows(transactions, window), years)


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return features.customer_features(rolled_up(spark, folder))


def valued(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with purchases times order value as their predicted value, staged."""
    return stage(split.summary_target(tables.customers(spark, folder)), "valued")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched customers, staged for reports that take several passes."""
    return stage(scoring.enrich(valued(spark, folder)), "scored")


# ---- flagship, split and target ----

@query(
    "flagship_segment_revenue",
    f"""WITH {ROLL}, edges AS (SELECT quantile_cont(total_revenue, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM roll),
    named AS (SELECT total_revenue, CASE WHEN total_revenue <= q[2] THEN 'Low Value'
      WHEN total_revenue <= q[3] THEN 'Low-Medium' WHEN total_revenue <= q[4] THEN 'Medium'
      WHEN total_revenue <= q[5] THEN 'Medium-High' ELSE 'High Value' END AS customer_segment FROM roll, edges)
    SELECT customer_segment, count(*) AS customers, {money('total_revenue')} AS revenue,
    round({money('total_revenue')} / (SELECT {money('total_revenue')} FROM named) * 100, 6) AS percentage
    FROM named GROUP BY customer_segment""",
)
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Windowed transactions to customer revenue to value segments to their revenue share."""
    transactions, window = windowed(spark, folder)
    spent = split.feature_rows(transactions, window).groupBy("customer_id")
    revenue = stage(spent.agg(scalars.money_sum(F.col("total_amount")).alias("predicted_clv")), "revenue")
    edges = binning.quantile_edges(revenue, "predicted_clv", len(fixed.SEGMENTS))
    named = revenue.withColumn("customer_segment", scoring.segment(edges))
    total = F.broadcast(named.agg(scalars.money_sum(F.col("predicted_clv")).alias("total")))
    per_segment = named.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customers"), scalars.money_sum(F.col("predicted_clv")).alias("revenue")
    )
    share = F.try_divide("revenue", "total") * 100
    return six_digits(per_segment.crossJoin(total).withColumn("percentage", share).drop("total"))


@query(
    "p1_temporal_split",
    f"""WITH {TXN} SELECT 'features' AS part, count(*) AS lines, count(DISTINCT customer_id) AS customers,
    strftime(min(invoice_date), '%Y-%m-%d %H:%M:%S') AS first_day,
    strftime(max(invoice_date), '%Y-%m-%d %H:%M:%S') AS last_day FROM feat
    UNION ALL SELECT 'target', count(*), count(DISTINCT customer_id),
    strftime(min(invoice_date), '%Y-%m-%d %H:%M:%S'), strftime(max(invoice_date), '%Y-%m-%d %H:%M:%S')
    FROM txn, bounds WHERE invoice_date > hi""",
)
def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    transactions, window = windowed(spark, folder)

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(
            F.lit(name).alias("part"),
            F.count(F.lit(1)).alias("lines"),
            F.count_distinct("customer_id").alias("customers"),
            F.min("invoice_date").alias("first_day"),
            F.max("invoice_date").alias("last_day"),
        )

    both = part(split.feature_rows(transactions, window), "features").union(
        part(split.target_rows(transactions, window), "target")
    )
    return day(both, "first_day", "last_day")


@query("a2_future_value", f"WITH {TXN} SELECT customer_id, {r6('predicted_clv')} FROM future")
def future_value(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(split.future_value(split.target_rows(*windowed(spark, folder))))


@query(
    "j1_f18_target",
    f"""WITH {ROLL} SELECT customer_id, total_transactions, round(coalesce(predicted_clv, 0), 6) AS predicted_clv
    FROM roll LEFT JOIN future USING (customer_id)""",
)
def target(spark: SparkSession, folder: str) -> DataFrame:
    transactions, window = windowed(spark, folder)
    counts = split.feature_rows(transactions, window).groupBy("customer_id")
    counts = counts.agg(F.count("invoice_date").alias("total_transactions"))
    return six_digits(split.attach_target(counts, split.future_value(split.target_rows(transactions, window))))


@query("f19_summary_target", f"WITH {CLV} SELECT customer_id, {r6('predicted_clv')} FROM clv")
def summary_target(spark: SparkSession, folder: str) -> DataFrame:
    valued_customers = split.summary_target(tables.customers(spark, folder))
    return six_digits(valued_customers.select("customer_id", "predicted_clv"))


# ---- rollup and features ----

ROLLUP_EXACT = [
    "total_transactions",
    "unique_invoices",
    "unique_products",
    "years_active",
    "months_active",
    "quarters_active",
]
ROLLUP_DOUBLE = [
    "total_revenue",
    "avg_order_value",
    "min_order_value",
    "max_order_value",
    "median_order_value",
    "total_quantity",
    "avg_quantity",
    "avg_unit_price",
    "weekend_purchase_rate",
]
ROLLUP_SPREAD = ["std_order_value", "std_quantity", "std_unit_price"]
PREFERRED = """preferred_day_of_week::INTEGER AS preferred_day_of_week,
    preferred_hour::INTEGER AS preferred_hour, preferred_season"""


@query(
    "a1_customer_rollup",
    f"""WITH {ROLL} SELECT customer_id, {STAMP.format('first_purchase')}, {STAMP.format('last_purchase')},
    {', '.join(ROLLUP_EXACT)}, {r6(*ROLLUP_DOUBLE)},
    {', '.join(f'round({c}, 4) AS {c}' for c in ROLLUP_SPREAD)}, {PREFERRED} FROM rolled""",
)
def rollup(spark: SparkSession, folder: str) -> DataFrame:
    transactions, window = windowed(spark, folder)
    years = (int(window.start[:4]), int(window.end[:4]))
    table = customer_rollup(split.feature_rows(transactions, window), years)
    return day(six_digits(table, **dict.fromkeys(ROLLUP_SPREAD, 4)), "first_purchase", "last_purchase")


BEHAVIOUR = [
    "avg_days_between_purchases",
    "purchase_frequency",
    "purchase_velocity",
    "product_diversity_ratio",
    "revenue_per_transaction",
    "revenue_growth_potential",
    "monetary",
]


@query(
    "f1_f10_f17_behaviour",
    f"""WITH {FEATURES} SELECT customer_id, customer_lifespan, days_since_last_purchase, recency, frequency,
    {r6(*BEHAVIOUR)}, round(coalesce(spending_consistency, 0), 6) AS spending_consistency,
    round(coalesce(std_order_value, 0), 4) AS std_order_value FROM f2""",
)
def behaviour(spark: SparkSession, folder: str) -> DataFrame:
    table = rolled_up(spark, folder)
    newest = table.agg(F.max("last_purchase").alias("newest"))
    made = features.behaviour(table.crossJoin(F.broadcast(newest)), F.col("newest"))
    exact = ["customer_id", "customer_lifespan", "days_since_last_purchase", "recency", "frequency"]
    chosen = made.select(*exact, *BEHAVIOUR, "spending_consistency", "std_order_value")
    return six_digits(features.zero_missing_numbers(chosen), std_order_value=4)


@query(
    "f11_f13_rfm_scores",
    f"""WITH {FEATURES} SELECT customer_id, recency_score, frequency_score, monetary_score FROM f4""",
)
def rfm(spark: SparkSession, folder: str) -> DataFrame:
    return feature_table(spark, folder).select("customer_id", "recency_score", "frequency_score", "monetary_score")


@query(
    "f14_f15_churn_signals",
    f"WITH {FEATURES} SELECT customer_id, churn_flag, {r6('churn_probability')} FROM f4",
)
def churn(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(feature_table(spark, folder).select("customer_id", "churn_flag", "churn_probability"))


@query(
    "f16_w7_season_encoding",
    f"WITH {FEATURES} SELECT customer_id, preferred_season, season_encoded::INTEGER AS season_encoded FROM f4",
)
def season_encoding(spark: SparkSession, folder: str) -> DataFrame:
    table = rolled_up(spark, folder).select("customer_id", "preferred_season")
    return features.encode_labels(table, "preferred_season", MODES["season"], "season_encoded")


FULL = [c for c in fixed.TRANSACTION_FEATURES if c not in ROLLUP_SPREAD]


@query(
    "f_all_training_table",
    f"""WITH {FEATURES}, t AS (
      SELECT f4.*, coalesce(future.predicted_clv, 0) AS predicted_clv FROM f4 LEFT JOIN future USING (customer_id))
    SELECT customer_id, {', '.join(f'round(coalesce({c}, 0)::DOUBLE, 6) AS {c}' for c in FULL)},
    {', '.join(f'round(coalesce({c}, 0)::DOUBLE, 4) AS {c}' for c in ROLLUP_SPREAD)},
    round(predicted_clv, 6) AS predicted_clv, round((rank() OVER (ORDER BY predicted_clv) +
      (count(*) OVER (PARTITION BY predicted_clv) - 1) / 2::DOUBLE) / (count(*) OVER ())::DOUBLE * 100, 6)
      AS clv_percentile FROM t""",
)
def training_table(spark: SparkSession, folder: str) -> DataFrame:
    """All model inputs with target and target percentile, from cleaned transactions."""
    table = pipeline.training_table(windowed(spark, folder)[0])
    doubles = table.select(
        "customer_id",
        *[F.col(c).cast("double").alias(c) for c in fixed.TRANSACTION_FEATURES],
        "predicted_clv",
        "clv_percentile",
    )
    return six_digits(doubles, **dict.fromkeys(ROLLUP_SPREAD, 4))


# ---- ranks, quantiles and bins ----

@query(
    "w1_percent_rank",
    f"WITH {SCORED} SELECT customer_id, {r6('percentile_rank')} FROM scored",
)
def percent_rank(spark: SparkSession, folder: str) -> DataFrame:
    ranked = order.percent_rank(valued(spark, folder), "predicted_clv", "percentile_rank", ["customer_id"])
    return six_digits(ranked.select("customer_id", "percentile_rank"))


@query(
    "w1_percent_rank_line_quantity",
    """SELECT l_orderkey, l_linenumber, l_partkey, round((rank() OVER (ORDER BY l_quantity) +
    (count(*) OVER (PARTITION BY l_quantity) - 1) / 2::DOUBLE) / (count(*) OVER ())::DOUBLE * 100, 6) AS pct
    FROM lineitem""",
)
def percent_rank_ties(spark: SparkSession, folder: str) -> DataFrame:
    """The same rank over a column of 50 heavily repeated values, cut into small cells."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = tables.table(spark, folder, "lineitem").select(*keys, "l_quantity")
    return six_digits(order.percent_rank(lines, "l_quantity", "pct", keys, cell_rows=5000).select(*keys, "pct"))


@query(
    "w2_first_rank",
    """WITH n AS (SELECT o_custkey::VARCHAR AS customer_id, count(*) AS frequency FROM orders GROUP BY 1)
    SELECT customer_id, frequency, row_number() OVER (ORDER BY frequency, customer_id) AS first_rank FROM n""",
)
def first_rank(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.table(spark, folder, "orders")
    counts = orders.groupBy(F.col("o_custkey").cast("string").alias("customer_id"))
    counts = stage(counts.agg(F.count(F.lit(1)).alias("frequency")), "counts")
    placed = order.row_positions(counts, ["frequency", "customer_id"], counts.count())
    return placed.select("customer_id", "frequency", (F.col("position") + 1).alias("first_rank"))


@query(
    "w3_quantile_bins",
    f"""WITH {ROLL}, e AS (SELECT quantile_cont(total_revenue, [0.2, 0.4, 0.6, 0.8]) AS q FROM roll)
    SELECT customer_id, CASE WHEN total_revenue <= q[1] THEN 1 WHEN total_revenue <= q[2] THEN 2
    WHEN total_revenue <= q[3] THEN 3 WHEN total_revenue <= q[4] THEN 4 ELSE 5 END AS score FROM roll, e""",
)
def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    spent = split.feature_rows(*windowed(spark, folder)).groupBy("customer_id")
    revenue = stage(spent.agg(scalars.money_sum(F.col("total_amount")).alias("revenue")), "revenue")
    edges = binning.quantile_edges(revenue, "revenue", 5)
    return revenue.select("customer_id", binning.quantile_score(F.col("revenue"), edges, features.SCORES).alias("score"))


@query(
    "w4_equal_width_fallback",
    """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_quantity < 25 THEN 25::DOUBLE ELSE l_quantity END AS v FROM lineitem),
    b AS (SELECT min(v) AS lo, max(v) AS hi FROM q)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v <= lo + (hi - lo) / 5 THEN 5
    WHEN v <= lo + (hi - lo) / 5 * 2 THEN 4 WHEN v <= lo + (hi - lo) / 5 * 3 THEN 3
    WHEN v <= lo + (hi - lo) / 5 * 4 THEN 2 ELSE 1 END AS score FROM q, b""",
)
def equal_width(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the values are equal, so quantile edges repeat and bins become equally wide."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    value = F.greatest(F.col("l_quantity"), F.lit(25.0)).alias("v")
    lines = tables.table(spark, folder, "lineitem").select(*keys, value)
    edges = binning.quantile_edges(lines, "v", 5)
    return lines.select(*keys, binning.quantile_score(F.col("v"), edges, features.SCORES[::-1]).alias("score"))


@query("w5_segments", f"WITH {SCORED} SELECT customer_id, customer_segment FROM scored")
def segments(spark: SparkSession, folder: str) -> DataFrame:
    table = valued(spark, folder)
    edges = binning.quantile_edges(table, "predicted_clv", len(fixed.SEGMENTS))
    return table.select("customer_id", scoring.segment(edges).alias("customer_segment"))


@query(
    "w6_exact_quantiles",
    """SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6)
    AS q50, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95,
    round(quantile_cont(l_extendedprice, 0.999), 6) AS q999 FROM lineitem""",
)
def exact_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Order statistics found by narrowing the value range, with small cells."""
    lines = tables.table(spark, folder, "lineitem").select("l_extendedprice")
    wanted = {"q25": (1, 4), "q50": (1, 2), "q95": (95, 100), "q999": (999, 1000)}
    found = order.quantiles(lines, "l_extendedprice", list(wanted.values()), cell_rows=5000)
    one_row = lines.agg(F.count(F.lit(1)).alias("rows"))
    return six_digits(one_row.select(*[F.lit(v).alias(n) for n, v in zip(wanted, found)]))


@query(
    "w6_grouped_quantiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
    round(median(l_extendedprice), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75
    FROM lineitem GROUP BY l_returnflag""",
)
def grouped_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Three groups that hold a third of all rows each, split into small cells."""
    lines = tables.table(spark, folder, "lineitem")
    wanted = {"q25": (1, 4), "q50": (1, 2), "q75": (3, 4)}
    return six_digits(order.grouped_quantiles(lines, ["l_returnflag"], "l_extendedprice", wanted, cell_rows=4000))


@query(
    "w10_spearman",
    f"""WITH {PAIRS}, r AS (
      SELECT rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2::DOUBLE AS a,
        rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2::DOUBLE AS p FROM pairs)
    SELECT round(corr(a, p), 6) AS ranking_correlation FROM r""",
)
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(metrics.evaluate(pairs(spark, folder)).select("ranking_correlation"))


# ---- scores and metrics ----

def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Actual future value against half of the past revenue, staged."""
    transactions, window = windowed(spark, folder)
    past = split.feature_rows(transactions, window).groupBy("customer_id")
    past = past.agg((scalars.money_sum(F.col("total_amount")) * 0.5).alias("predicted"))
    joined = split.attach_target(past, split.future_value(split.target_rows(transactions, window)))
    return stage(joined.select("customer_id", F.col("predicted_clv").alias("actual"), "predicted"), "pairs")


TOP = """(SELECT count(*) FILTER (ra <= k AND rp <= k)::DOUBLE / max(k) FROM (
      SELECT row_number() OVER (ORDER BY actual DESC, customer_id) AS ra,
        row_number() OVER (ORDER BY predicted DESC, customer_id) AS rp,
        greatest(1, floor(count(*) OVER () * 0.1)) AS k FROM pairs))"""


@query(
    "m13_business_metrics",
    f"""WITH {PAIRS}, r AS (
      SELECT *, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2::DOUBLE AS a,
        rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2::DOUBLE AS p FROM pairs)
    SELECT round(avg((actual - predicted) ^ 2), 2) AS mse, round(sqrt(avg((actual - predicted) ^ 2)), 4) AS rmse,
    round(avg(abs(actual - predicted)), 4) AS mae,
    round(1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)), 6) AS r2,
    round(avg(abs(actual - predicted) / actual) FILTER (actual > 0), 6) AS mape,
    round(corr(a, p), 6) AS ranking_correlation, round({TOP}, 6) AS top_10_precision FROM r""",
)
def business_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(metrics.evaluate(pairs(spark, folder)), mse=2, rmse=4, mae=4)


@query(
    "p6_nonzero_mape",
    f"""WITH {PAIRS} SELECT round(avg(abs(actual - predicted) / actual) FILTER (actual > 0), 6) AS mape FROM pairs""",
)
def nonzero_mape(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(metrics.fit_quality(pairs(spark, folder)).select("mape"))


@query("j2_top_decile_overlap", f"WITH {PAIRS} SELECT round({TOP}, 6) AS top_10_precision")
def top_overlap(spark: SparkSession, folder: str) -> DataFrame:
    table = pairs(spark, folder)
    return six_digits(table.agg(metrics.top_overlap(table, table.count()).alias("top_10_precision")))


@query("w8_churn_risk", f"WITH {SCORED} SELECT customer_id, {r6('churn_risk')} FROM scored")
def churn_risk(spark: SparkSession, folder: str) -> DataFrame:
    table = valued(spark, folder)
    largest = table.agg(F.max("predicted_clv")).first()[0]
    return six_digits(table.select("customer_id", scoring.churn_risk(largest).alias("churn_risk")))


@query(
    "w9_confidence_band",
    f"""WITH {SCORED} SELECT customer_id, round(confidence_lower, 4) AS confidence_lower,
    round(confidence_upper, 4) AS confidence_upper FROM scored""",
)
def confidence_band(spark: SparkSession, folder: str) -> DataFrame:
    table = valued(spark, folder)
    deviation = table.agg(F.stddev_samp("predicted_clv")).first()[0]
    sides = {"confidence_lower": scoring.band(deviation, -1), "confidence_upper": scoring.band(deviation, 1)}
    return six_digits(table.withColumns(sides).select("customer_id", *sides), digits=4)


SCORE_COLUMNS = ["predicted_clv", "churn_risk", "percentile_rank"]


@query(
    "m17_score_enrichment",
    f"""WITH {SCORED} SELECT customer_id, age, total_purchases, customer_segment, {r6(*SCORE_COLUMNS)},
    round(confidence_lower, 4) AS confidence_lower, round(confidence_upper, 4) AS confidence_upper FROM scored""",
)
def score_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "age", "total_purchases", "customer_segment", *SCORE_COLUMNS]
    table = scoring.enrich(valued(spark, folder)).select(*columns, "confidence_lower", "confidence_upper")
    return six_digits(table, confidence_lower=4, confidence_upper=4)


@query(
    "e1_discounted_value",
    f"""WITH {CLV}, f AS (SELECT sum(pow(1.05, -m / 12::DOUBLE)) / 12 AS year FROM (SELECT unnest(range(1, 13)) AS m))
    SELECT customer_id, round(predicted_clv * year, 6) AS discounted_clv FROM clv, f""",
)
def discounted_value(spark: SparkSession, folder: str) -> DataFrame:
    value = scoring.discounted(F.col("predicted_clv"), months=12, yearly_rate=0.05)
    return six_digits(valued(spark, folder).select("customer_id", value.alias("discounted_clv")))


@query(
    "j4_share_of_total",
    f"""WITH {CLV} SELECT customer_id, round(predicted_clv / (SELECT {money('predicted_clv')} FROM clv) * 100, 6)
    AS share FROM clv""",
)
def share_of_total(spark: SparkSession, folder: str) -> DataFrame:
    table = valued(spark, folder)
    total = F.broadcast(table.agg(scalars.money_sum(F.col("predicted_clv")).alias("total")))
    share = F.try_divide("predicted_clv", "total") * 100
    return six_digits(table.crossJoin(total).select("customer_id", share.alias("share")))


# ---- filters and top rows ----

@query("p2_high_risk", f"WITH {SCORED} SELECT customer_id, {r6('churn_risk')} FROM scored WHERE churn_risk > 0.5")
def high_risk(spark: SparkSession, folder: str) -> DataFrame:
    table = scoring.enrich(valued(spark, folder))
    return six_digits(scoring.high_risk(table).select("customer_id", "churn_risk"))


STRATEGY = """CASE WHEN customer_segment = 'High Value' AND churn_risk < 0.3 THEN 'retain_and_grow'
    WHEN customer_segment = 'High Value' THEN 'retention_focus'
    WHEN customer_segment IN ('Low Value', 'Low-Medium') AND churn_risk < 0.3 THEN 'growth_focus'
    WHEN customer_segment IN ('Low Value', 'Low-Medium') THEN 'win_back_or_let_go' END"""


@query("p3_action_quadrants", f"WITH {SCORED} SELECT customer_id, {STRATEGY} AS strategy FROM scored")
def action_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    return strategies.with_strategy(scoring.enrich(valued(spark, folder))).select("customer_id", "strategy")


@query(
    "p4_result_filter",
    f"""WITH {SCORED} SELECT customer_id, customer_segment, {r6('predicted_clv')} FROM scored
    WHERE customer_segment IN ('Medium', 'High Value') AND predicted_clv >= 2500000 AND churn_risk <= 0.55""",
)
def result_filter(spark: SparkSession, folder: str) -> DataFrame:
    table = scoring.enrich(valued(spark, folder))
    kept = scoring.filter_results(table, ["Medium", "High Value"], 2_500_000.0, 0.55)
    return six_digits(kept.select("customer_id", "customer_segment", "predicted_clv"))


DISPLAY = f"SELECT customer_id, customer_segment, {r6(*SCORE_COLUMNS)} FROM scored"


@query("t2_top_customers", f"WITH {SCORED} {DISPLAY} ORDER BY scored.predicted_clv DESC, customer_id LIMIT 10")
def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.top_customers(scored(spark, folder), rounded=False))


@query(
    "t3_top_tenth",
    f"""WITH {SCORED}, ranked AS (SELECT customer_id, row_number() OVER (ORDER BY predicted_clv DESC, customer_id)
    AS r, floor(count(*) OVER () * 0.1) AS k FROM scored) SELECT customer_id FROM ranked WHERE r <= k""",
)
def top_tenth(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_tenth(valued(spark, folder)).select("customer_id")


@query(
    "t4_top_high_risk",
    f"WITH {SCORED} {DISPLAY} WHERE scored.churn_risk > 0.5 ORDER BY scored.predicted_clv DESC, customer_id LIMIT 10",
)
def top_high_risk(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.top_high_risk(scored(spark, folder), rounded=False))


@query(
    "t8_r7_band_sample",
    f"""WITH {SCORED} SELECT customer_id, {r6('predicted_clv', 'confidence_lower', 'confidence_upper')}
    FROM scored ORDER BY md5(scored.customer_id), scored.customer_id LIMIT 50""",
)
def band_sample(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.band_sample(scored(spark, folder)))


# ---- report tables ----

def _segments_sql(columns: str) -> str:
    return f"""WITH {SCORED}, labels(customer_segment, sort_order) AS {LABELS}
    SELECT customer_segment, sort_order, {columns} FROM labels LEFT JOIN scored USING (customer_segment)
    GROUP BY customer_segment, sort_order"""


COUNT = "count(predicted_clv) AS predicted_clv_count"
SUM = f"round({money('predicted_clv')}, 6) AS predicted_clv_sum"
MEAN = f"round({money('predicted_clv')} / count(predicted_clv), 6) AS predicted_clv_mean"
MEDIAN = "round(median(predicted_clv), 6) AS predicted_clv_median"
STD = "round(stddev_samp(predicted_clv), 4) AS predicted_clv_std"
ENDS = "round(min(predicted_clv), 6) AS predicted_clv_min, round(max(predicted_clv), 6) AS predicted_clv_max"
RISK = "round(avg(churn_risk), 6) AS churn_risk_mean"
RANK = "round(avg(percentile_rank), 6) AS percentile_rank_mean"


@query(
    "a3_r8_segment_summary",
    _segments_sql(
        f"""{COUNT}, {MEAN}, {MEDIAN}, {STD}, {ENDS}, {RISK}, round(median(churn_risk), 6) AS churn_risk_median,
        {RANK}, round(median(percentile_rank), 6) AS percentile_rank_median"""
    ),
)
def segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.segment_summary(scored(spark, folder), digits=None), predicted_clv_std=4)


@query(
    "a4_segment_revenue",
    _segments_sql(
        f"""round({money('predicted_clv')}, 6) AS predicted_clv,
        round({money('predicted_clv')} / (SELECT {money('predicted_clv')} FROM scored) * 100, 6) AS percentage"""
    ),
)
def segment_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.segment_revenue(scored(spark, folder), digits=None))


@query(
    "a5_insight_table",
    f"""WITH {PAIRS}, e AS (SELECT quantile_cont(predicted, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM pairs),
    named AS (SELECT pairs.*, CASE WHEN predicted <= q[2] THEN 'Low Value' WHEN predicted <= q[3] THEN 'Low-Medium'
      WHEN predicted <= q[4] THEN 'Medium' WHEN predicted <= q[5] THEN 'Medium-High' ELSE 'High Value' END
      AS customer_segment FROM pairs, e),
    labels(customer_segment, sort_order) AS {LABELS}
    SELECT customer_segment, sort_order, count(predicted) AS predicted_clv_count,
    round({money('predicted')} / count(predicted), 6) AS predicted_clv_mean,
    round(median(predicted), 6) AS predicted_clv_median, round(stddev_samp(predicted), 4) AS predicted_clv_std,
    round(avg(actual), 4) AS actual_clv_mean, round(median(actual), 6) AS actual_clv_median,
    round(stddev_samp(actual), 4) AS actual_clv_std FROM labels LEFT JOIN named USING (customer_segment)
    GROUP BY ALL""",
)
def insight_table(spark: SparkSession, folder: str) -> DataFrame:
    named = {"predicted": "predicted_clv", "actual": "actual_clv"}
    table = stage(scoring.enrich(pairs(spark, folder).withColumnsRenamed(named)), "scored")
    spread = dict.fromkeys(["predicted_clv_std", "actual_clv_std", "actual_clv_mean"], 4)
    return six_digits(reports.insight_table(table, digits=None), **spread)


@query(
    "a6_revenue_impact",
    f"""WITH {SCORED}, s AS (SELECT {money('predicted_clv')} AS t,
      fsum(predicted_clv) FILTER (customer_segment = 'High Value') AS h FROM scored)
    SELECT t AS total_predicted_clv, h AS high_value_contribution, round(h / t * 100, 6) AS high_value_percentage
    FROM s""",
)
def revenue_impact(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.revenue_impact(scored(spark, folder)))


@query(
    "a7_r10_portfolio",
    f"""WITH {CLV} SELECT count(*) AS total_customers, {money('predicted_clv')} AS total_clv,
    round({money('predicted_clv')} / count(*), 6) AS avg_clv, round(stddev_samp(predicted_clv), 4) AS clv_std,
    round(median(predicted_clv), 6) AS median_clv,
    round(quantile_cont(predicted_clv, 0.25), 6) AS clv_25th_percentile,
    round(quantile_cont(predicted_clv, 0.75), 6) AS clv_75th_percentile,
    round(quantile_cont(predicted_clv, 0.90), 6) AS clv_90th_percentile,
    round(quantile_cont(predicted_clv, 0.95), 6) AS clv_95th_percentile FROM clv""",
)
def portfolio(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.portfolio(valued(spark, folder)), clv_std=4)


@query("a8_segment_metrics", _segments_sql(f"{COUNT}, {SUM}, {MEAN}, {MEDIAN}, {STD}, {RISK}, {RANK}"))
def segment_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.segment_metrics(scored(spark, folder), digits=None), predicted_clv_std=4)


@query(
    "a9_value_tiers",
    f"""WITH {SCORED}, e AS (SELECT quantile_cont(predicted_clv, [0.25, 0.5, 0.75]) AS t FROM scored),
    tiers AS (SELECT scored.*, CASE WHEN predicted_clv <= t[1] THEN 1 WHEN predicted_clv <= t[2] THEN 2
      WHEN predicted_clv <= t[3] THEN 3 ELSE 4 END AS sort_order FROM scored, e)
    SELECT ['Bronze', 'Silver', 'Gold', 'Platinum'][sort_order] AS tier, sort_order, {COUNT}, {SUM}, {MEAN}, {RISK}
    FROM tiers GROUP BY sort_order""",
)
def value_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.tier_table(scored(spark, folder), digits=None))


EXPOSURE = f"""SELECT count(*) FILTER (churn_risk > 0.5) AS high_risk_count,
    round(count(*) FILTER (churn_risk > 0.5)::DOUBLE / count(*) * 100, 6) AS high_risk_percentage,
    fsum(predicted_clv) FILTER (churn_risk > 0.5) AS high_risk_clv_value FROM scored"""


@query("a10_risk_exposure", f"WITH {SCORED} {EXPOSURE}")
def risk_exposure(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.risk_exposure(scored(spark, folder)))


CONCENTRATION = f"""SELECT t AS top_10_percent_revenue, round(t / total * 100, 6) AS top_10_percent_share FROM (
      SELECT fsum(predicted_clv) FILTER (r <= k) AS t, {money('predicted_clv')} AS total
      FROM (SELECT predicted_clv, row_number() OVER (ORDER BY predicted_clv DESC) AS r,
        floor(count(*) OVER () * 0.1) AS k FROM scored))"""


@query("a11_revenue_concentration", f"WITH {SCORED} {CONCENTRATION}")
def revenue_concentration(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.revenue_concentration(scored(spark, folder)))


@query("a12_segment_comparison", _segments_sql(f"{COUNT}, {MEAN}, {MEDIAN}, {SUM}, {RISK}, {RANK}"))
def segment_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.segment_comparison(scored(spark, folder), digits=None))


@query(
    "a13_r6_channel_segments",
    f"WITH {SCORED} SELECT acquisition_channel, customer_segment, count(*) AS count FROM scored GROUP BY ALL",
)
def channel_segments(spark: SparkSession, folder: str) -> DataFrame:
    return reports.channel_segments(scored(spark, folder))


@query(
    "a14_r6_value_by_location",
    f"""WITH {CLV} SELECT location, round({money('predicted_clv')} / count(*), 6) AS predicted_clv FROM clv
    GROUP BY location""",
)
def value_by_location(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.mean_value_by(valued(spark, folder), "location"))


@query(
    "a14_r6_value_by_subscription",
    f"""WITH {CLV} SELECT subscription_status, round({money('predicted_clv')} / count(*), 6) AS predicted_clv
    FROM clv GROUP BY subscription_status""",
)
def value_by_subscription(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.mean_value_by(valued(spark, folder), "subscription_status"))


@query(
    "a15_r3_segment_counts",
    f"WITH {SCORED} SELECT customer_segment, count(*) AS count FROM scored GROUP BY customer_segment ORDER BY 2 DESC, 1",
)
def segment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.segment_counts(scored(spark, folder))


@query(
    "a16_score_tiles",
    f"""WITH {SCORED} SELECT round({money('predicted_clv')} / count(*), 6) AS avg_clv,
    {money('predicted_clv')} AS total_clv, count(*) FILTER (customer_segment = 'High Value') AS high_value_customers,
    round(avg(churn_risk), 6) AS avg_churn_risk FROM scored""",
)
def score_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.score_tiles(scored(spark, folder)))


# the texts stand here once more, so that a wrong one among the engine's fixed values is found
ACTION_TEXTS = """(VALUES
  ('retain_and_grow', 'Retain And Grow', 'Premium loyalty programs; Exclusive early access to new products; Personalized VIP customer service; Cross-selling and upselling opportunities; Referral program incentives'),
  ('retention_focus', 'Retention Focus', 'Proactive customer outreach; Personalized retention offers; Customer satisfaction surveys; Issue resolution prioritization; Loyalty program enrollment'),
  ('growth_focus', 'Growth Focus', 'Product education and training; Bundle offers and promotions; Usage optimization recommendations; Feature adoption campaigns; Cross-selling initiatives'),
  ('win_back_or_let_go', 'Win Back Or Let Go', 'Targeted win-back campaigns; Special reactivation offers; Customer feedback collection; Service improvement opportunities; Consider reducing marketing spend'))
  AS texts(strategy, label, actions)"""


@query(
    "a17_recommendations",
    f"""WITH {SCORED}, s AS (SELECT predicted_clv, {STRATEGY} AS strategy FROM scored)
    SELECT strategy, label, count(*) AS count, round({money('predicted_clv')} / count(*), 6) AS avg_clv, actions
    FROM s JOIN {ACTION_TEXTS} USING (strategy) GROUP BY strategy, label, actions""",
)
def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    found = strategies.recommendations(scored(spark, folder))
    label = scalars.title_words(F.col("strategy")).alias("label")
    return six_digits(found.select("strategy", label, "count", "avg_clv", F.array_join("actions", "; ").alias("actions")))


@query(
    "a21_filter_choices",
    f"WITH {SCORED} SELECT DISTINCT customer_segment FROM scored",
)
def filter_choices(spark: SparkSession, folder: str) -> DataFrame:
    return reports.filter_choices(scored(spark, folder))


@query(
    "a22_verdicts",
    f"""WITH {SCORED}, c AS ({CONCENTRATION}), e AS ({EXPOSURE})
    SELECT top_10_percent_share, CASE WHEN top_10_percent_share > 50 THEN 'concentrated' ELSE 'healthy' END
    AS revenue_verdict, high_risk_percentage, CASE WHEN high_risk_percentage > 30 THEN 'high'
    WHEN high_risk_percentage > 15 THEN 'moderate' ELSE 'low' END AS churn_verdict FROM c, e""",
)
def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.verdicts(scored(spark, folder)))


@query(
    "fn_display_formats",
    f"""WITH {SCORED} SELECT customer_id, format('${{:,.2f}}', predicted_clv) AS clv,
    format('{{:.2f}}%', churn_risk * 100) AS risk, format('{{:.1f}}%', percentile_rank) AS rank FROM scored""",
)
def display_formats(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.enrich(valued(spark, folder)).select(
        "customer_id",
        scalars.currency(F.col("predicted_clv")).alias("clv"),
        scalars.percent(F.col("churn_risk")).alias("risk"),
        scalars.percent_points(F.col("percentile_rank")).alias("rank"),
    )


def _histogram_sql(column: str, bins: int) -> str:
    return f"""WITH {SCORED}, b AS (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins} AS w FROM scored)
    SELECT least(floor(({column} - lo) / w), {bins - 1})::INTEGER AS bin, count(*) AS count,
    round(any_value(lo) + least(floor(({column} - lo) / w), {bins - 1}) * any_value(w), 6) AS lower
    FROM scored, b GROUP BY least(floor(({column} - lo) / w), {bins - 1})"""


@query("r1_clv_histogram", _histogram_sql("predicted_clv", 20))
def clv_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.histogram(scored(spark, folder), "predicted_clv", 20))


@query("r2_churn_histogram", _histogram_sql("churn_risk", 15))
def churn_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.histogram(scored(spark, folder), "churn_risk", 15))


@query("r2_percentile_histogram", _histogram_sql("percentile_rank", 20))
def percentile_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.histogram(scored(spark, folder), "percentile_rank", 20))


@query(
    "r4_box_plot",
    f"""WITH {SCORED} SELECT customer_segment, round(min(predicted_clv), 6) AS low, round(max(predicted_clv), 6) AS high,
    round(quantile_cont(predicted_clv, 0.25), 6) AS q1, round(median(predicted_clv), 6) AS median,
    round(quantile_cont(predicted_clv, 0.75), 6) AS q3 FROM scored GROUP BY customer_segment""",
)
def box_plot(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.box_plot(scored(spark, folder)))


@query(
    "r5_scatter_points",
    f"""WITH {SCORED} SELECT customer_id, age, total_purchases, customer_segment,
    {r6('avg_order_value', *SCORE_COLUMNS)} FROM scored""",
)
def scatter_points(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.scatter_points(scored(spark, folder)))


@query(
    "r5_scatter_grid",
    f"""WITH {SCORED}, b AS (SELECT min(age)::DOUBLE AS x0, (max(age) - min(age))::DOUBLE / 100 AS xw,
      min(predicted_clv) AS y0, (max(predicted_clv) - min(predicted_clv)) / 100 AS yw FROM scored)
    SELECT customer_segment, least(floor((age - x0) / xw), 99)::INTEGER AS x,
    least(floor((predicted_clv - y0) / yw), 99)::INTEGER AS y, count(*) AS count FROM scored, b GROUP BY ALL""",
)
def scatter_grid(spark: SparkSession, folder: str) -> DataFrame:
    return reports.scatter_grid(scored(spark, folder), "age")


@query(
    "r10_report_bundle",
    f"""WITH {SCORED}, t AS (SELECT quantile_cont(predicted_clv, [0.25, 0.5, 0.75]) AS q, min(predicted_clv) AS lo,
        (max(predicted_clv) - min(predicted_clv)) / 20 AS w FROM scored),
      kinds AS (
        SELECT 'segment' AS report, customer_segment AS key, predicted_clv, churn_risk FROM scored
        UNION ALL SELECT 'tier', CASE WHEN predicted_clv <= q[1] THEN 'Bronze' WHEN predicted_clv <= q[2] THEN 'Silver'
          WHEN predicted_clv <= q[3] THEN 'Gold' ELSE 'Platinum' END, predicted_clv, churn_risk FROM scored, t
        UNION ALL SELECT 'channel_segment', acquisition_channel || '/' || customer_segment, predicted_clv, churn_risk FROM scored
        UNION ALL SELECT 'location', location, predicted_clv, churn_risk FROM scored
        UNION ALL SELECT 'subscription_status', subscription_status, predicted_clv, churn_risk FROM scored
        UNION ALL SELECT 'clv_distribution', least(floor((predicted_clv - lo) / w), 19)::INTEGER::VARCHAR, predicted_clv, churn_risk FROM scored, t
        UNION ALL SELECT 'all', '', predicted_clv, churn_risk FROM scored)
    SELECT report, key, count(*) AS customers, round({money('predicted_clv')}, 4) AS total, round({money('predicted_clv')} / count(*), 4) AS mean,
      round(max(predicted_clv), 6) AS largest, round(avg(churn_risk), 6) AS churn, count(*) FILTER (churn_risk > 0.5) AS risky
    FROM kinds GROUP BY ALL""",
)
def report_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Segments, tiers, channels, places, states, a histogram and the totals, all from the one aggregate of a bundle."""
    made = bundle.Bundle(scored(spark, folder))
    keys = {name: F.col(f"k_{name}").cast("string") for name in ("segment", "tier", "location", "subscription_status", "clv_distribution")}
    keys |= {"channel_segment": F.concat_ws("/", "k_acquisition_channel", "k_segment"), "all": F.lit("")}
    figures = [F.col("rows").alias("customers"), F.round("sum", 4).alias("total"), F.round("mean", 4).alias("mean"), F.round("max", 6).alias("largest"), F.round("churn", 6).alias("churn"), "risky"]
    parts = [made.part(name, F.lit(name).alias("report"), key.alias("key"), *figures) for name, key in keys.items()]
    return reduce(DataFrame.unionAll, parts)


# ---- models: results depend on the learner, so only shape is compared ----

@query("m1_m14_leaderboard")
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """All four regressors on transaction features, with search, folds and metrics."""
    table = pipeline.training_table(windowed(spark, folder)[0])
    columns = modeling.feature_columns(table)
    model = modeling.train_models(modeling.model_input(table, columns, "predicted_clv"), columns, modeling.TrainConfig())
    return model.leaderboard(spark)


HOLED = f"""{CUST},
  holed AS (
    SELECT customer_id, ('0x' || substr(md5('42|' || customer_id), 1, 8))::BIGINT % 100 < 20 AS is_test,
      CASE WHEN age % 9 <> 0 THEN age END::DOUBLE AS age, total_purchases::DOUBLE AS total_purchases,
      CASE WHEN customer_id::BIGINT % 13 <> 0 THEN avg_order_value END AS avg_order_value,
      days_since_first_purchase::DOUBLE AS days_since_first_purchase, days_since_last_purchase::DOUBLE AS days_since_last_purchase,
      acquisition_channel, location, CASE WHEN customer_id::BIGINT % 17 <> 0 THEN subscription_status END AS subscription_status
    FROM cust),
  middle AS (SELECT median(age) AS age, median(avg_order_value) AS value, min(acquisition_channel) AS channel,
    min(location) AS location, min(subscription_status) AS status FROM holed WHERE NOT is_test)"""


def holed_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customer summaries in which some ages, values and statuses are missing or infinite."""
    number = F.col("customer_id").cast("bigint")
    return split.summary_target(tables.customers(spark, folder)).withColumns(
        {
            "age": F.when(F.col("age") % 9 != 0, F.col("age")),
            "avg_order_value": F.when(number % 13 == 0, F.lit(float("inf"))).otherwise(F.col("avg_order_value")),
            "subscription_status": F.when(number % 17 != 0, F.col("subscription_status")),
        }
    )


@query(
    "m2_m3_preprocessing",
    f"""WITH {HOLED} SELECT customer_id, coalesce(h.age, m.age) AS age, total_purchases,
      round(coalesce(avg_order_value, value), 6) AS avg_order_value, days_since_first_purchase, days_since_last_purchase,
      concat_ws('|', CASE WHEN acquisition_channel <> channel THEN 'acquisition_channel_' || acquisition_channel END,
        CASE WHEN h.location <> m.location THEN 'location_' || h.location END,
        CASE WHEN subscription_status <> status THEN 'subscription_status_' || subscription_status END) AS ones
      FROM holed h, middle m""",
)
def preprocessing(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of customer summaries with holes by a pipeline fitted on the training rows, saved and loaded again."""
    table = holed_customers(spark, folder)
    columns = modeling.feature_columns(table)
    ready = stage(modeling.mark_test(modeling.model_input(table, columns, "predicted_clv"), modeling.TrainConfig()), "input")
    fitted, names = modeling.fit_preprocessing(ready.where(~F.col("is_test")), columns, cell_rows=500)
    path = new_path(spark, "preprocessing")
    fitted.write().save(path)
    values = vector_to_array("features")
    numeric = [c for c in columns if c in names]
    ones = [F.when(F.get(values, F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(names) if n not in numeric]
    filled = [F.get(values, F.lit(i)).alias(c) for i, c in enumerate(numeric)]
    return six_digits(PipelineModel.load(path).transform(ready).select("customer_id", *filled, F.concat_ws("|", *ones).alias("ones")))


ONE_INPUT = f"""{CLV},
  drawn AS (
    SELECT customer_id, total_purchases::DOUBLE AS x, predicted_clv AS y,
      ('0x' || substr(md5('42|' || customer_id), 1, 8))::BIGINT % 100 < 20 AS is_test,
      ('0x' || substr(md5('43|' || customer_id), 1, 8))::BIGINT % 2 AS fold FROM clv),
  scaled AS (SELECT *, x / (SELECT stddev_samp(x) FROM drawn WHERE NOT is_test) AS s FROM drawn),
  fits AS (
    SELECT model, part, regr_sxy(y, s) / (regr_sxx(y, s) + alpha) AS slope, avg(y) AS my, avg(s) AS ms
    FROM scaled, (VALUES ('Linear_Regression', 0.0), ('Ridge_Regression', 10.0)) AS m(model, alpha), (VALUES (-1), (0), (1)) AS p(part)
    WHERE NOT is_test AND fold <> part GROUP BY model, part, alpha),
  errors AS (
    SELECT model, part, is_test, fold, y, my + slope * (s - ms) AS predicted FROM scaled, fits),
  quality AS (
    SELECT model, part, is_test, fold, grouping_id(fold) AS whole, 1 - sum((y - predicted) ** 2) / (var_pop(y) * count(*)) AS r2,
      sqrt(avg((y - predicted) ** 2)) AS rmse, avg(abs(y - predicted)) AS mae, avg(abs(y - predicted) / y) FILTER (y > 0) AS mape
    FROM errors GROUP BY GROUPING SETS ((model, part, is_test), (model, part, is_test, fold)))"""


@query(
    "m6_m7_m12_m14_one_input",
    f"""WITH {ONE_INPUT}
    SELECT model, round(a.r2, 6) AS train_r2, round(b.r2, 6) AS test_r2, round(a.rmse, 4) AS train_rmse, round(b.rmse, 4) AS test_rmse,
      round(b.mae, 4) AS test_mae, round(b.mape, 6) AS test_mape, round(c.mean, 6) AS cv_r2_mean, round(c.std, 6) AS cv_r2_std
    FROM (SELECT * FROM quality WHERE part = -1 AND whole = 1 AND NOT is_test) a
    JOIN (SELECT * FROM quality WHERE part = -1 AND whole = 1 AND is_test) b USING (model)
    JOIN (SELECT model, avg(r2) AS mean, stddev_pop(r2) AS std FROM quality WHERE whole = 0 AND part = fold AND NOT is_test GROUP BY model) c USING (model)""",
)
def one_input(spark: SparkSession, folder: str) -> DataFrame:
    """Linear and ridge regression on one input, where both have a closed form: every figure of the leaderboard."""
    table = split.summary_target(tables.customers(spark, folder))
    config = modeling.TrainConfig(models=("Linear_Regression", "Ridge_Regression"), ridge_alphas=(10.0,))
    model = modeling.train_models(modeling.model_input(table, ["total_purchases"], "predicted_clv"), ["total_purchases"], config)
    figures = ["train_r2", "test_r2", "train_rmse", "test_rmse", "test_mae", "test_mape", "cv_r2_mean", "cv_r2_std"]
    return six_digits(model.leaderboard(spark).select("model", *figures), train_rmse=4, test_rmse=4, test_mae=4)


@query(
    "m16_one_input_predictions",
    f"""WITH {ONE_INPUT} SELECT customer_id, model, round(my + slope * (s - ms), 4) AS predicted
    FROM scaled, fits WHERE part = -1""",
)
def one_input_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """What the loaded linear and ridge models of one input predict for every customer."""
    table = stage(split.summary_target(tables.customers(spark, folder)), "training")
    config = modeling.TrainConfig(models=("Linear_Regression", "Ridge_Regression"), ridge_alphas=(10.0,))
    model = modeling.train_models(modeling.model_input(table, ["total_purchases"], "predicted_clv"), ["total_purchases"], config)
    path = new_path(spark, "model")
    modeling.save_model(model, spark, path)
    loaded = modeling.load_model(spark, path)
    parts = [loaded.predict(table, name).select("customer_id", F.lit(name).alias("model"), F.round("predicted_clv", 4).alias("predicted")) for name in model.models]
    return reduce(DataFrame.unionAll, parts)


@query("m11_grid_search")
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The leaderboard of grids with several values of each parameter over customer summaries; ensembles are scored by prefixes."""
    table = split.summary_target(tables.customers(spark, folder))
    columns = modeling.feature_columns(table)
    config = modeling.TrainConfig(
        folds=3, ridge_alphas=(0.1, 1.0, 10.0), forest_trees=(10, 20), forest_depths=(5, 8), boosting_rounds=(5, 10), boosting_rates=(0.05, 0.1)
    )
    model = modeling.train_models(modeling.model_input(table, columns, "predicted_clv"), columns, config)
    return model.leaderboard(spark)


@query(
    "m5_train_test_split",
    f"""WITH {CUST} SELECT ('0x' || substr(md5('42|' || customer_id), 1, 8))::BIGINT % 100 < 20 AS is_test,
    count(*) AS count FROM cust GROUP BY ALL""",
)
def train_test(spark: SparkSession, folder: str) -> DataFrame:
    marked = modeling.mark_test(tables.customers(spark, folder), modeling.TrainConfig())
    return marked.groupBy("is_test").agg(F.count(F.lit(1)).alias("count"))


@query("m15_t5_r9_importance")
def importance(spark: SparkSession, folder: str) -> DataFrame:
    table = pipeline.training_table(windowed(spark, folder)[0])
    columns = modeling.feature_columns(table)
    config = modeling.TrainConfig(models=("Random_Forest",))
    model = modeling.train_models(modeling.model_input(table, columns, "predicted_clv"), columns, config)
    return model.importance(spark).limit(10)


@query(
    "m16_s8_saved_model_scores",
    f"""WITH {CUST} SELECT customer_id, model, true AS same_value, true AS enriched FROM cust,
    (VALUES ('Linear_Regression'), ('Ridge_Regression'), ('Random_Forest'), ('Gradient_Boosting')) AS m(model)""",
)
def saved_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All four models fitted on customer summaries, published twice, loaded and scored; each value against that before saving."""
    table = stage(split.summary_target(tables.customers(spark, folder)), "training")
    columns = modeling.feature_columns(table)
    model = modeling.train_models(modeling.model_input(table, columns, "predicted_clv"), columns, modeling.TrainConfig())
    path = new_path(spark, "model")
    modeling.save_model(model, spark, path)
    modeling.save_model(model, spark, path)
    loaded = modeling.load_model(spark, path)
    parts = []
    for name in model.models:
        before = model.predict(table, name).select("customer_id", F.col("predicted_clv").alias("before"))
        after = scoring.enrich(stage(loaded.predict(table, name), "predicted"), on_ties="merge")
        enriched = F.col("customer_segment").isNotNull() & F.col("percentile_rank").between(0, 100) & F.col("churn_risk").isNotNull()
        same = F.abs(F.col("predicted_clv") - F.col("before")) <= 1e-9 * F.abs("before")
        parts.append(after.join(before, "customer_id").select("customer_id", F.lit(name).alias("model"), same.alias("same_value"), enriched.alias("enriched")))
    return reduce(DataFrame.unionAll, parts)


@query(
    "m18_r11_held_out_predictions",
    f"""WITH {CLV} SELECT customer_id, round(predicted_clv, 6) AS actual_clv, true AS predicted, true AS in_segment FROM clv
    WHERE ('0x' || substr(md5('42|' || customer_id), 1, 8))::BIGINT % 100 < 20""",
)
def held_out(spark: SparkSession, folder: str) -> DataFrame:
    """The full training run; predicted against actual value of the held-out customers."""
    fitted = pipeline.fit_pipeline(spark, tables.customers(spark, folder))
    predicted = scalars.finite(F.col("predicted_clv")).isNotNull()
    segment = F.col("customer_segment").isin("Low Value", "Low-Medium", "Medium", "Medium-High", "High Value")
    return six_digits(
        fitted.predictions.select("customer_id", "actual_clv", predicted.alias("predicted"), segment.alias("in_segment"))
    )
