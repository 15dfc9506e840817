"""SQL building blocks: the same inputs and scores as plain common table expressions."""

from __future__ import annotations

SEGMENTS = ["Low Value", "Low-Medium", "Medium", "Medium-High", "High Value"]

TXN = """
txn AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS invoice,
         CAST(l_partkey AS VARCHAR) AS stock_code, o_orderdate AS invoice_date, l_quantity AS quantity,
         l_extendedprice / l_quantity AS unit_price, l_extendedprice AS total_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
bounds AS (
  SELECT max(invoice_date) - INTERVAL 540 DAY AS lo, max(invoice_date) - INTERVAL 180 DAY AS hi FROM txn),
feat AS (SELECT txn.* FROM txn, bounds WHERE invoice_date BETWEEN lo AND hi),
future AS (
  SELECT customer_id, fsum(total_amount) AS predicted_clv
  FROM txn, bounds WHERE invoice_date > hi GROUP BY customer_id)"""

SEASON = """CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) IN (3, 4, 5) THEN 'Spring'
  WHEN month({0}) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""

ROLL = f"""{TXN},
roll AS (
  SELECT customer_id, min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase,
    count(*) AS total_transactions, count(DISTINCT invoice) AS unique_invoices,
    fsum(total_amount) AS total_revenue,
    fsum(total_amount) / count(*) AS avg_order_value,
    stddev_samp(total_amount) AS std_order_value, min(total_amount) AS min_order_value,
    max(total_amount) AS max_order_value, median(total_amount) AS median_order_value,
    fsum(quantity) AS total_quantity,
    fsum(quantity) / count(*) AS avg_quantity,
    stddev_samp(quantity) AS std_quantity, count(DISTINCT stock_code) AS unique_products,
    avg(unit_price) AS avg_unit_price, stddev_samp(unit_price) AS std_unit_price,
    count(DISTINCT year(invoice_date)) AS years_active, count(DISTINCT month(invoice_date)) AS months_active,
    count(DISTINCT quarter(invoice_date)) AS quarters_active,
    count(*) FILTER (isodow(invoice_date) > 5)::DOUBLE / count(*) AS weekend_purchase_rate
  FROM feat GROUP BY customer_id),
dow_mode AS (
  SELECT customer_id, d AS preferred_day_of_week FROM (
    SELECT customer_id, d, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, d) AS r FROM (
      SELECT customer_id, isodow(invoice_date) - 1 AS d, count(*) AS n FROM feat GROUP BY ALL)) WHERE r = 1),
hour_mode AS (
  SELECT customer_id, d AS preferred_hour FROM (
    SELECT customer_id, d, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, d) AS r FROM (
      SELECT customer_id, hour(invoice_date) AS d, count(*) AS n FROM feat GROUP BY ALL)) WHERE r = 1),
season_mode AS (
  SELECT customer_id, d AS preferred_season FROM (
    SELECT customer_id, d, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, d) AS r FROM (
      SELECT customer_id, {SEASON.format('invoice_date')} AS d, count(*) AS n FROM feat GROUP BY ALL)) WHERE r = 1),
rolled AS (
  SELECT * FROM roll JOIN dow_mode USING (customer_id) JOIN hour_mode USING (customer_id)
  JOIN season_mode USING (customer_id))"""

FEATURES = f"""{ROLL},
f1 AS (
  SELECT *, date_diff('day', first_purchase, last_purchase) AS customer_lifespan,
    date_diff('day', last_purchase, max(last_purchase) OVER ()) AS days_since_last_purchase FROM rolled),
f2 AS (
  SELECT *, customer_lifespan::DOUBLE / greatest(total_transactions - 1, 1) AS avg_days_between_purchases,
    total_transactions::DOUBLE / greatest(customer_lifespan + 1, 1) AS purchase_frequency,
    total_transactions::DOUBLE / greatest(customer_lifespan, 1) AS purchase_velocity,
    unique_products::DOUBLE / total_transactions AS product_diversity_ratio,
    1 / (1 + std_order_value / greatest(avg_order_value, 0.01)) AS spending_consistency,
    total_revenue / total_transactions AS revenue_per_transaction,
    max_order_value / avg_order_value AS revenue_growth_potential,
    days_since_last_purchase AS recency, total_transactions AS frequency, total_revenue AS monetary FROM f1),
f_edges AS (
  SELECT quantile_cont(recency::DOUBLE, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS r,
         quantile_cont(monetary, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS m, count(*) AS n FROM f2),
f3 AS (
  SELECT f2.*,
    CASE WHEN recency <= r[2] THEN 5 WHEN recency <= r[3] THEN 4 WHEN recency <= r[4] THEN 3
         WHEN recency <= r[5] THEN 2 ELSE 1 END AS recency_score,
    CASE WHEN monetary <= m[2] THEN 1 WHEN monetary <= m[3] THEN 2 WHEN monetary <= m[4] THEN 3
         WHEN monetary <= m[5] THEN 4 ELSE 5 END AS monetary_score,
    row_number() OVER (ORDER BY frequency, customer_id) - 1 AS place, n FROM f2, f_edges),
f4 AS (
  SELECT *, CASE WHEN 5 * place <= n - 1 THEN 1 WHEN 5 * place <= 2 * (n - 1) THEN 2
      WHEN 5 * place <= 3 * (n - 1) THEN 3 WHEN 5 * place <= 4 * (n - 1) THEN 4 ELSE 5 END AS frequency_score,
    CASE WHEN days_since_last_purchase > avg_days_between_purchases * 2.0 THEN 1 ELSE 0 END AS churn_flag,
    least(days_since_last_purchase / greatest(avg_days_between_purchases * 2.0, 1.0), 1.0) AS churn_probability,
    dense_rank() OVER (ORDER BY preferred_season) - 1 AS season_encoded FROM f3)"""

CUST = """
spent AS (
  SELECT o_custkey, count(*) AS total_purchases,
    fsum(o_totalprice) / count(*) AS avg_order_value,
    min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey),
cust AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, (18 + c_custkey % 70)::BIGINT AS age, total_purchases,
    avg_order_value, date_diff('day', a, (SELECT max(o_orderdate) FROM orders)) AS days_since_first_purchase,
    date_diff('day', b, (SELECT max(o_orderdate) FROM orders)) AS days_since_last_purchase,
    c_mktsegment AS acquisition_channel, r_name AS location,
    CASE WHEN c_acctbal < 0 THEN 'none' WHEN c_acctbal < 5000 THEN 'inactive' ELSE 'active' END
      AS subscription_status
  FROM customer JOIN spent ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

CLV = f"""{CUST},
clv AS (SELECT *, total_purchases * avg_order_value AS predicted_clv FROM cust)"""

SEGMENT_CASE = "CASE " + " ".join(
    f"WHEN predicted_clv <= q[{i + 2}] THEN '{name}'" for i, name in enumerate(SEGMENTS[:-1])
) + f" ELSE '{SEGMENTS[-1]}' END"

SCORED = f"""{CLV},
edges AS (SELECT quantile_cont(predicted_clv, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q,
  max(predicted_clv) AS top, stddev_samp(predicted_clv) AS dev FROM clv),
scored AS (
  SELECT clv.*, {SEGMENT_CASE} AS customer_segment, 1 - predicted_clv / top AS churn_risk,
    (rank() OVER (ORDER BY predicted_clv) + (count(*) OVER (PARTITION BY predicted_clv) - 1) / 2::DOUBLE)
      / (count(*) OVER ())::DOUBLE * 100 AS percentile_rank,
    predicted_clv - 1.96 * dev AS confidence_lower, predicted_clv + 1.96 * dev AS confidence_upper
  FROM clv, edges)"""

PAIRS = f"""{ROLL},
pairs AS (
  SELECT customer_id, coalesce(predicted_clv, 0) AS actual, total_revenue * 0.5 AS predicted
  FROM roll LEFT JOIN future USING (customer_id))"""

RAW = """
raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_linenumber AS VARCHAR) AS line,
    CAST(l_partkey AS VARCHAR) AS stock_code,
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
    CASE WHEN l_tax = 0.08 THEN NULL ELSE o_orderdate END AS invoice_date,
    CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / l_quantity END AS unit_price,
    CASE WHEN o_custkey % 11 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sales AS (
  SELECT *, quantity * unit_price AS total_amount FROM raw
  WHERE customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0 AND invoice_date IS NOT NULL)"""

LABELS = "(VALUES " + ", ".join(f"('{s}', {i + 1})" for i, s in enumerate(SEGMENTS)) + ")"


def money(expression: str) -> str:
    return f"fsum({expression})"


def r6(*names: str) -> str:
    """Columns rounded to six digits under their own names."""
    return ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in names)
