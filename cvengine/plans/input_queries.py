"""Queries over cleaning, validation, batches and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.functions import scalars
from cvengine.operators import batches, cleaning, logs, quality, reports
from cvengine.plans import pipeline
from cvengine.plans.check_sql import CUST, RAW, SEASON, r6
from cvengine.plans.registry import CHECK_SQL, day, query, six_digits
from cvengine.session import new_path, stage
from cvengine.sources import readers, retained_log, schemas, sinks, tables
from cvengine.streaming import action_log

CUSTOMER_COLUMNS = """customer_id, age, total_purchases, round(avg_order_value, 6) AS avg_order_value,
  days_since_first_purchase, days_since_last_purchase, acquisition_channel, location, subscription_status"""
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("c1_c2_header_aliases", f"WITH {CUST} SELECT {CUSTOMER_COLUMNS} FROM cust")
def header_aliases(spark: SparkSession, folder: str) -> DataFrame:
    odd = tables.customers(spark, folder).toDF(
        " Cust_ID ",
        "Age",
        "Purchase Count",
        "Avg Spend",
        "First Purchase Days",
        "Recency Days",
        "Channel",
        "Region",
        "Sub Status",
    )
    return six_digits(cleaning.apply_aliases(cleaning.tidy_headers(odd)))


@query(
    "c3_retail_headers",
    f"""WITH {RAW} SELECT invoice, line, stock_code, quantity, {STAMP.format('invoice_date')} AS invoice_date,
    round(unit_price, 8) AS unit_price, customer_id FROM raw""",
)
def retail_headers(spark: SparkSession, folder: str) -> DataFrame:
    raw = cleaning.retail_headers(tables.raw_retail(spark, folder))
    typed = raw.withColumns({c: scalars.number(F.col(c)) for c in ("quantity", "unit_price")})
    dated = typed.withColumn("invoice_date", scalars.timestamp(F.col("invoice_date")))
    return six_digits(day(dated, "invoice_date"), unit_price=8)


@query(
    "c5_date_coercion",
    f"""WITH {RAW} SELECT invoice, line, {STAMP.format('invoice_date')} AS invoice_date FROM raw
    WHERE invoice_date IS NOT NULL""",
)
def date_coercion(spark: SparkSession, folder: str) -> DataFrame:
    raw = cleaning.retail_headers(tables.raw_retail(spark, folder))
    return day(cleaning.coerce_dates(raw).select("invoice", "line", "invoice_date"), "invoice_date")


@query(
    "c6_number_coercion",
    f"""WITH {CUST} SELECT customer_id,
    CASE WHEN customer_id::BIGINT % 13 = 0 THEN 0 ELSE round(avg_order_value, 6) END AS avg_order_value,
    CASE WHEN customer_id::BIGINT % 17 = 0 THEN 0 ELSE total_purchases::DOUBLE END AS total_purchases FROM cust""",
)
def number_coercion(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("customer_id").cast("bigint")
    text = tables.customers(spark, folder).select(
        "customer_id",
        F.when(number % 13 == 0, "n/a").otherwise(F.col("avg_order_value").cast("string")).alias("avg_order_value"),
        F.when(number % 17 != 0, F.col("total_purchases").cast("string")).alias("total_purchases"),
    )
    return six_digits(cleaning.coerce_numbers(text, ["avg_order_value", "total_purchases"]))


@query(
    "c7_recency_clamp",
    f"""WITH {CUST} SELECT customer_id, days_since_first_purchase,
    least(days_since_last_purchase * 3, days_since_first_purchase) AS days_since_last_purchase FROM cust""",
)
def recency_clamp(spark: SparkSession, folder: str) -> DataFrame:
    late = tables.customers(spark, folder).select(
        "customer_id", "days_since_first_purchase", (F.col("days_since_last_purchase") * 3).alias("days_since_last_purchase")
    )
    return cleaning.clamp_recency(late)


@query(
    "c8_default_columns",
    f"""WITH {CUST} SELECT customer_id, total_purchases, 35 AS age, 'Unknown' AS acquisition_channel,
    location, 'None' AS subscription_status FROM cust""",
)
def default_columns(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.add_defaults(tables.customers(spark, folder).select("customer_id", "total_purchases", "location"))


@query(
    "c9_c15_customer_ids",
    f"WITH {RAW} SELECT customer_id, count(*) AS lines FROM raw WHERE customer_id IS NOT NULL GROUP BY customer_id",
)
def customer_ids(spark: SparkSession, folder: str) -> DataFrame:
    kept = cleaning.drop_missing_ids(cleaning.retail_headers(tables.raw_retail(spark, folder)))
    ids = kept.withColumn("customer_id", F.col("customer_id").cast("string"))
    return ids.groupBy("customer_id").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "c10_c11_sales_amounts",
    f"""WITH {RAW} SELECT invoice, line, customer_id, quantity,
    round(unit_price, 8) AS unit_price, {r6('total_amount')} FROM sales""",
)
def sales_amounts(spark: SparkSession, folder: str) -> DataFrame:
    sales = cleaning.sale_rows(tables.raw_retail(spark, folder))
    columns = ["invoice", "line", "customer_id", "quantity", "unit_price", "total_amount"]
    return six_digits(sales.select(*columns), unit_price=8)


@query(
    "c12_outlier_trim",
    f"""WITH {RAW}, cap AS (SELECT quantile_cont(total_amount, 0.999) AS q FROM sales)
    SELECT invoice, line, {r6('total_amount')} FROM sales, cap WHERE total_amount <= q""",
)
def outlier_trim(spark: SparkSession, folder: str) -> DataFrame:
    sales = cleaning.sale_rows(tables.raw_retail(spark, folder)).select("invoice", "line", "total_amount")
    return six_digits(cleaning.trim_outliers(stage(sales, "sales")))


@query(
    "c13_c14_calendar",
    f"""SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, quarter(ts)::INTEGER AS quarter,
    (isodow(ts) - 1)::INTEGER AS day_of_week, hour(ts)::INTEGER AS hour, (isodow(ts) > 5)::INTEGER AS is_weekend,
    {SEASON.format('ts')} AS season FROM events
    UNION ALL
    SELECT o_orderkey, year(o_orderdate), month(o_orderdate), quarter(o_orderdate), isodow(o_orderdate) - 1,
    hour(o_orderdate), (isodow(o_orderdate) > 5)::INTEGER, {SEASON.format('o_orderdate')} FROM orders""",
)
def calendar(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events").select("event_id", F.col("ts").alias("invoice_date"))
    orders = tables.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return cleaning.calendar_columns(events.union(orders)).drop("invoice_date")


@query(
    "c16_clean_transactions",
    f"""WITH {RAW}, cap AS (SELECT quantile_cont(total_amount, 0.999) AS q FROM sales)
    SELECT customer_id, {SEASON.format('invoice_date')} AS season, year(invoice_date)::INTEGER AS year,
    count(*) AS lines, round(fsum(total_amount), 6) AS revenue
    FROM sales, cap WHERE total_amount <= q GROUP BY ALL""",
)
def cleaned_transactions(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = cleaning.clean_transactions(tables.raw_retail(spark, folder))
    return six_digits(
        cleaned.groupBy("customer_id", "season", "year").agg(
            F.count(F.lit(1)).alias("lines"), scalars.money_sum(F.col("total_amount")).alias("revenue")
        )
    )


def flawed_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with wrong ages, swapped days, negative values and repeated ids."""
    number = F.col("customer_id").cast("bigint")
    return tables.customers(spark, folder).withColumns(
        {
            "customer_id": F.when(number % 31 == 0, "0").otherwise(F.col("customer_id")),
            "age": F.when(number % 19 == 0, -1).when(number % 23 == 0, 130).otherwise(F.col("age")),
            "avg_order_value": F.when(number % 7 == 0, -F.col("avg_order_value")).otherwise(F.col("avg_order_value")),
            "days_since_last_purchase": F.when(number % 5 == 0, F.col("days_since_first_purchase") + 1).otherwise(
                F.col("days_since_last_purchase")
            ),
        }
    )


FLAWED = f"""{CUST},
flawed AS (
  SELECT CASE WHEN customer_id::BIGINT % 31 = 0 THEN '0' ELSE customer_id END AS customer_id,
    CASE WHEN customer_id::BIGINT % 19 = 0 THEN -1 WHEN customer_id::BIGINT % 23 = 0 THEN 130 ELSE age END AS age,
    total_purchases,
    CASE WHEN customer_id::BIGINT % 7 = 0 THEN -avg_order_value ELSE avg_order_value END AS avg_order_value,
    days_since_first_purchase,
    CASE WHEN customer_id::BIGINT % 5 = 0 THEN days_since_first_purchase + 1 ELSE days_since_last_purchase END
      AS days_since_last_purchase
  FROM cust)"""


@query(
    "d2_validation_rules",
    f"""WITH {FLAWED}
    SELECT 'negative age' AS rule, 'error' AS level, count(*) FILTER (age < 0) AS violations FROM flawed
    UNION ALL SELECT 'negative total_purchases', 'error', count(*) FILTER (total_purchases < 0) FROM flawed
    UNION ALL SELECT 'negative avg_order_value', 'error', count(*) FILTER (avg_order_value < 0) FROM flawed
    UNION ALL SELECT 'negative days_since_first_purchase', 'error',
      count(*) FILTER (days_since_first_purchase < 0) FROM flawed
    UNION ALL SELECT 'negative days_since_last_purchase', 'error',
      count(*) FILTER (days_since_last_purchase < 0) FROM flawed
    UNION ALL SELECT 'last purchase before first', 'error',
      count(*) FILTER (days_since_last_purchase > days_since_first_purchase) FROM flawed
    UNION ALL SELECT 'unrealistic age', 'warning', count(*) FILTER (age < 13 OR age > 120) FROM flawed
    UNION ALL SELECT 'duplicate customer id', 'error', count(*) - count(DISTINCT customer_id) FROM flawed""",
)
def validation_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.validate(flawed_customers(spark, folder))


@query(
    "u3_duplicate_ids",
    f"WITH {FLAWED} SELECT customer_id, count(*) AS count FROM flawed GROUP BY customer_id HAVING count(*) > 1",
)
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_ids(flawed_customers(spark, folder))


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _outlier_sql(table: str, columns: list[str]) -> str:
    quartiles = ", ".join(
        f"quantile_cont({c}::DOUBLE, 0.25) AS a_{c}, quantile_cont({c}::DOUBLE, 0.75) AS b_{c}" for c in columns
    )
    shares = " + ".join(
        f"""count(*) FILTER ({c} < a_{c} - (b_{c} - a_{c}) * 1.5::DOUBLE
        OR {c} > b_{c} + (b_{c} - a_{c}) * 1.5::DOUBLE)::DOUBLE / count(*)"""
        for c in columns
    )
    return f"SELECT ({shares}) / {len(columns)} * 100 AS outlier_rate FROM {table}, (SELECT {quartiles} FROM {table})"


@query(
    "d3_d6_quality_score",
    f"""WITH c AS (SELECT 100.0::DOUBLE AS completeness FROM (SELECT 1)),
    d AS (SELECT (sum(n) - count(*))::DOUBLE / sum(n) * 100 AS duplicate_rate
      FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
        l_returnflag, l_linestatus, l_shipdate)),
    o AS ({_outlier_sql('lineitem', LINE_NUMBERS)})
    SELECT completeness, round(duplicate_rate, 6) AS duplicate_rate, round(outlier_rate, 6) AS outlier_rate,
    round(completeness * 0.6 - duplicate_rate * 0.2 - outlier_rate * 0.2, 6) AS overall_score FROM c, d, o""",
)
def line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(quality.quality_score(tables.table(spark, folder, "lineitem")))


@query(
    "d3_completeness",
    f"""WITH {RAW} SELECT round(100 - (count(*) FILTER (invoice_date IS NULL) + count(*) FILTER (customer_id IS NULL))
    ::DOUBLE / (count(*) * 7) * 100, 6) AS completeness FROM raw""",
)
def raw_completeness(spark: SparkSession, folder: str) -> DataFrame:
    raw = cleaning.retail_headers(tables.raw_retail(spark, folder))
    return six_digits(quality.completeness(raw.withColumn("invoice_date", scalars.timestamp(F.col("invoice_date")))))


@query(
    "u4_d4_duplicate_rows",
    """SELECT round((sum(n) - count(*))::DOUBLE / sum(n) * 100, 6) AS duplicate_rate FROM (
    SELECT count(*) AS n FROM events GROUP BY user_id, event_type, props)""",
)
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events").select("user_id", "event_type", "props")
    return six_digits(quality.duplicate_rate(events))


@query(
    "d5_outlier_rate",
    f"""WITH o AS ({_outlier_sql('events', ['event_id', 'user_id', 'value'])})
    SELECT round(outlier_rate, 6) AS outlier_rate FROM o""",
)
def event_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(quality.outlier_rate(tables.table(spark, folder, "events")))


def incoming_customers(spark: SparkSession, folder: str) -> DataFrame:
    """New records: every customer again, a third without an id, some with flaws."""
    number = F.col("customer_id").cast("bigint")
    return flawed_customers(spark, folder).withColumns(
        {
            "customer_id": F.when(number % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("customer_id"))),
            "total_purchases": F.when(number % 11 == 0, -1).otherwise(F.col("total_purchases")),
        }
    )


@query(
    "d7_new_record_rules",
    f"""WITH {FLAWED},
    incoming AS (
      SELECT CASE WHEN customer_id::BIGINT % 3 = 0 THEN '' ELSE customer_id END AS customer_id, age,
        CASE WHEN customer_id::BIGINT % 11 = 0 THEN -1 ELSE total_purchases END AS total_purchases,
        avg_order_value, days_since_first_purchase AS f, days_since_last_purchase AS l FROM flawed),
    known AS (SELECT customer_id FROM cust WHERE subscription_status = 'active'),
    checked AS (
      SELECT customer_id, concat_ws('; ', CASE WHEN customer_id = '' THEN 'customer id is empty' END,
        CASE WHEN customer_id IN (SELECT customer_id FROM known) THEN 'customer id exists' END,
        CASE WHEN age NOT BETWEEN 18 AND 100 THEN 'age outside 18 to 100' END,
        CASE WHEN total_purchases < 0 THEN 'negative purchases' END,
        CASE WHEN avg_order_value <= 0 THEN 'order value not positive' END,
        CASE WHEN f < 1 THEN 'first purchase less than a day ago' END,
        CASE WHEN l < 0 THEN 'negative days since last purchase' END,
        CASE WHEN l > f THEN 'last purchase before first' END) AS violations FROM incoming)
    SELECT customer_id, violations, count(*) AS records FROM checked GROUP BY ALL""",
)
def new_record_rules(spark: SparkSession, folder: str) -> DataFrame:
    existing = tables.customers(spark, folder).where(F.col("subscription_status") == "active")
    checked = batches.check_new(incoming_customers(spark, folder), existing)
    flat = checked.select("customer_id", F.array_join("violations", "; ").alias("violations"))
    return flat.groupBy("customer_id", "violations").agg(F.count(F.lit(1)).alias("records"))


def _by_status(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    people = tables.customers(spark, folder).select("customer_id", "age", "location", "subscription_status")
    return people.where(F.col("location") != "ASIA"), people.where(F.col("subscription_status") == "active")


@query(
    "j3_known_customers",
    f"""WITH {CUST} SELECT customer_id, CASE WHEN location <> 'ASIA' THEN 'known' ELSE 'new' END AS kind
    FROM cust WHERE subscription_status = 'active'""",
)
def known_customers(spark: SparkSession, folder: str) -> DataFrame:
    existing, incoming = _by_status(spark, folder)
    known = batches.already_known(incoming, existing).select("customer_id", F.lit("known").alias("kind"))
    return known.union(batches.not_yet_known(incoming, existing).select("customer_id", F.lit("new").alias("kind")))


@query(
    "u1_append_customers",
    f"""WITH {CUST} SELECT customer_id, age, location, subscription_status FROM cust WHERE location <> 'ASIA'
    UNION ALL SELECT customer_id, NULL, location, subscription_status FROM cust
    WHERE subscription_status = 'active'""",
)
def append_customers(spark: SparkSession, folder: str) -> DataFrame:
    existing, new = _by_status(spark, folder)
    return batches.append_customers(existing, new.drop("age"))


@query(
    "u2_remove_customers",
    f"""WITH {CUST} SELECT customer_id, age, location, subscription_status FROM cust
    WHERE location <> 'ASIA' AND subscription_status <> 'active'""",
)
def remove_customers(spark: SparkSession, folder: str) -> DataFrame:
    return batches.remove_customers(*_by_status(spark, folder))


@query(
    "a16_input_tiles",
    f"""WITH {CUST} SELECT count(*) AS total_customers, 100.0::DOUBLE AS data_completeness,
    round(avg(total_purchases), 6) AS avg_purchases, round(avg(avg_order_value), 4) AS avg_order_value FROM cust""",
)
def input_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.input_tiles(tables.customers(spark, folder)), avg_order_value=4)


def _newest(log: DataFrame) -> Column:
    """The newest time in the log, as a literal that a scan can filter by."""
    return F.lit(log.agg(F.max("timestamp")).first()[0])


@query(
    "s7_most_recent",
    f"""SELECT event_id::VARCHAR AS id, event_type AS action, user_id::VARCHAR AS session_id,
    {STAMP.format('ts')} AS timestamp FROM events ORDER BY ts DESC, event_id::VARCHAR LIMIT 1000""",
)
def most_recent(spark: SparkSession, folder: str) -> DataFrame:
    recent = logs.most_recent(tables.actions(spark, folder))
    return day(recent.select("id", "action", "session_id", "timestamp"), "timestamp")


@query(
    "s5_details",
    """SELECT event_id::VARCHAR AS id, json_extract_string(props, '$.k') AS k FROM events""",
)
def action_details(spark: SparkSession, folder: str) -> DataFrame:
    return tables.actions(spark, folder).select("id", F.col("details")["k"].alias("k"))


@query(
    "a18_action_summary",
    """SELECT count(*) AS total_actions,
    count(*) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS recent_actions FROM events""",
)
def action_summary(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.actions(spark, folder).select("timestamp")
    return logs.action_summary(log, _newest(log))


@query(
    "a18_popular_actions",
    "SELECT event_type AS action, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def popular_actions(spark: SparkSession, folder: str) -> DataFrame:
    return logs.popular_actions(tables.actions(spark, folder))


RATING = "CASE WHEN event_id % 7 <> 0 THEN 1 + event_id % 5 END"


@query(
    "a19_feedback_summary",
    f"""SELECT count(*) AS total_feedback, round(avg(coalesce({RATING}, 0)), 6) AS average_rating,
    count(*) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 168 HOUR) AS this_week FROM events""",
)
def feedback_summary(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.feedback(spark, folder)
    return six_digits(logs.feedback_summary(log, _newest(log)))


@query(
    "a20_request_summary",
    """SELECT count(*) AS total_requests, count(*) FILTER (event_id % 4 <> 0) AS pending,
    count(*) FILTER (event_id % 3 = 0) AS high_priority FROM events""",
)
def request_summary(spark: SparkSession, folder: str) -> DataFrame:
    return logs.request_summary(tables.feature_requests(spark, folder))


@query(
    "p7_trailing_week",
    """SELECT event_id::VARCHAR AS id, event_type AS feedback_type FROM events
    WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 168 HOUR""",
)
def trailing_week(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.feedback(spark, folder)
    return logs.trailing(log, _newest(log), 24 * 7).select("id", "feedback_type")


@query(
    "p8_feedback_display",
    f"""SELECT strftime(ts, '%Y-%m-%d %H:%M') AS "Date", event_type AS "Type",
    ({RATING})::INTEGER::VARCHAR || '/5' AS "Rating", 'user' || user_id || '@example.com' AS "Email",
    props AS "Feedback" FROM events""",
)
def feedback_display(spark: SparkSession, folder: str) -> DataFrame:
    return logs.feedback_display(tables.feedback(spark, folder))


@query(
    "t9_p8_requests_newest_first",
    """SELECT strftime(ts, '%Y-%m-%d %H:%M') AS "Date", 'request ' || event_id AS "Title",
    CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS "Priority",
    event_type AS "Category", CASE WHEN event_id % 4 = 0 THEN 'Completed' ELSE 'Pending' END AS "Status",
    'user' || user_id || '@example.com' AS "Email" FROM events ORDER BY ts DESC, event_id::VARCHAR""",
)
def requests_newest_first(spark: SparkSession, folder: str) -> DataFrame:
    return logs.request_display(logs.newest_first(tables.feature_requests(spark, folder)))


@query(
    "fn_clean_text",
    """WITH texts AS (
      SELECT 'd' || doc_id AS id, text FROM documents
      UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
    cleaned AS (
      SELECT id, replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '<', '&lt;'), '>', '&gt;') AS text
      FROM texts)
    SELECT id, md5(text) AS digest, length(text)::INTEGER AS length FROM cleaned""",
)
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = tables.table(spark, folder, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text"
    )
    talks = tables.table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text"
    )
    cleaned = documents.union(talks).withColumn("text", scalars.clean_text(F.col("text")))
    return cleaned.select("id", F.md5("text").alias("digest"), F.length("text").alias("length"))


DAILY = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type AS action, count(*) AS count
    FROM events"""


@query("x1_daily_counts_batch", f"{DAILY} GROUP BY 1, 2")
def daily_counts_batch(spark: SparkSession, folder: str) -> DataFrame:
    return day(action_log.daily_counts(tables.actions(spark, folder)), "day")


@query(
    "x1_daily_counts_stream",
    f"""{DAILY} WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
    GROUP BY 1, 2""",
)
def daily_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    return day(action_log.count_available(spark, f"{folder}/events*.parquet"), "day")


@query(
    "x2_log_intake",
    "SELECT event_id::VARCHAR AS id, event_type AS action FROM events WHERE event_id % 50 <> 0",
)
def log_intake(spark: SparkSession, folder: str) -> DataFrame:
    """Actions written as JSON lines, some malformed and each twice, taken in as a stream."""
    actions = tables.actions(spark, folder)
    flawed = actions.withColumn("action", F.when(F.col("id").cast("bigint") % 50 != 0, F.col("action")))
    path = new_path(spark, "incoming")
    flawed.union(flawed).write.json(path)
    taken = action_log.intake(spark, path, "40 days")
    sink = action_log.run_available(taken, new_path(spark, "taken"), new_path(spark, "taken-progress"))
    return sink.select("id", "action")


@query(
    "x2_log_rejects",
    "SELECT event_id::VARCHAR AS id, count(*) * 2 AS count FROM events WHERE event_id % 50 = 0 GROUP BY ALL",
)
def log_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The malformed records of the same intake, none of them lost."""
    actions = tables.actions(spark, folder)
    flawed = actions.withColumn("action", F.when(F.col("id").cast("bigint") % 50 != 0, F.col("action")))
    path = new_path(spark, "incoming")
    flawed.union(flawed).write.json(path)
    left = action_log.run_available(action_log.rejects(spark, path), new_path(spark, "rejects"), new_path(spark, "rejects-progress"))
    return left.groupBy("id").agg(F.count(F.lit(1)).alias("count"))


SENT = """e AS (SELECT *, (event_id * 4 // (SELECT max(event_id) + 1 FROM events))::BIGINT AS f FROM events),
  sent AS (
    SELECT CASE WHEN event_id % 23 = 0 THEN 3 ELSE f END AS batch, * FROM e
    UNION ALL SELECT CASE WHEN event_id % 23 = 0 THEN 3 ELSE f END, * FROM e WHERE event_id % 10 = 0
    UNION ALL SELECT least(f + 1, 3), * FROM e WHERE event_id % 15 = 0),
  newest AS (
    SELECT b.batch, max(s.ts) FILTER (s.batch < b.batch AND s.event_id % 50 NOT IN (1, 2)) AS newest
    FROM (SELECT DISTINCT batch FROM sent) b, sent s GROUP BY b.batch),
  marked AS (
    SELECT sent.batch, event_id, event_id % 50 AS flaw, coalesce(ts < newest - INTERVAL 1 DAY, false) AS late, ts
    FROM sent JOIN newest USING (batch))"""


@query(
    "x2_split_intake",
    f"""WITH {SENT} SELECT batch, kind, id, count(*) AS count FROM (
      SELECT batch, CASE WHEN flaw <> 2 THEN event_id::VARCHAR END AS id, CASE WHEN flaw IN (1, 2) THEN 'malformed' WHEN late THEN 'late'
        WHEN row_number() OVER (PARTITION BY event_id, flaw IN (1, 2), late ORDER BY batch, ts) = 1 THEN 'taken' ELSE 'repeated' END AS kind
      FROM marked) GROUP BY ALL""",
)
def split_intake(spark: SparkSession, folder: str) -> DataFrame:
    """Four files of actions, with repeats, late ones and lines that are no record, taken in batch by batch; all are in one of the parts."""
    actions = tables.actions(spark, folder).withColumn("number", F.col("id").cast("bigint"))
    last = actions.agg(F.max("number") + 1).first()[0]
    file, number = F.floor(F.col("number") * 4 / F.lit(last)).cast("int"), F.col("number")
    own = F.when(number % 23 == 0, 3).otherwise(file)
    sent = actions.withColumn("file", own).unionAll(actions.where(number % 10 == 0).withColumn("file", own))
    sent = sent.unionAll(actions.where(number % 15 == 0).withColumn("file", F.least(file + 1, F.lit(3))))
    sent = stage(sent.withColumn("action", F.when(number % 50 != 1, F.col("action"))), "sent")
    record = F.to_json(F.struct("timestamp", "action", "details", "session_id", "id"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    line = F.when(number % 50 == 2, F.concat(F.lit("{broken "), F.col("id"))).otherwise(record)
    path = new_path(spark, "incoming")
    for k in range(4):
        sent.where(F.col("file") == k).select(line.alias("value")).coalesce(1).write.mode("append").text(path)
    parts = action_log.split_intake(spark, path, new_path(spark, "intake"), new_path(spark, "intake-progress"), files_per_batch=1)
    return parts.groupBy("batch", "kind", "id").agg(F.count(F.lit(1)).alias("count"))


@query("s7_retained_log", CHECK_SQL["s7_most_recent"])
def kept_on_disk(spark: SparkSession, folder: str) -> DataFrame:
    """The newest entries of a log on disk after three appends and two compactions."""
    actions = tables.actions(spark, folder)
    stored = retained_log.RetainedLog(spark, new_path(spark, "log"), schemas.ACTION)
    part = F.col("id").cast("bigint") % 3
    stored.append(actions.where(part == 0))
    stored.compact()
    stored.append(actions.where(part == 1))
    stored.append(actions.where(part == 2))
    stored.compact()
    stored.clean()
    return day(stored.read().select("id", "action", "session_id", "timestamp"), "timestamp")


@query(
    "c5_c6_rejected_cells",
    f"""WITH {CUST},
      bad AS (
        SELECT customer_id, 'age' AS "column", age || ' years' AS raw, 'missing' AS becomes FROM cust WHERE age % 8 = 0
        UNION ALL SELECT customer_id, 'total_purchases', 'many', 'zero' FROM cust WHERE customer_id::BIGINT % 11 = 0
        UNION ALL SELECT customer_id, 'days_since_last_purchase', '1O', 'zero' FROM cust WHERE customer_id::BIGINT % 6 = 1),
      cleaned AS (
        SELECT customer_id, CASE WHEN age % 8 <> 0 THEN age END::DOUBLE AS age,
          CASE WHEN customer_id::BIGINT % 11 <> 0 AND customer_id::BIGINT % 5 <> 0 THEN total_purchases ELSE 0 END::DOUBLE AS total_purchases,
          CASE WHEN customer_id::BIGINT % 6 <> 1 THEN days_since_last_purchase ELSE 0 END::DOUBLE AS days_since_last_purchase FROM cust)
    SELECT customer_id AS id, "column", raw, becomes, age, total_purchases, days_since_last_purchase
    FROM cleaned LEFT JOIN bad USING (customer_id)""",
)
def rejected_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as text with cells that are no number: the cleaned numbers, and beside them each cell that was replaced."""
    text = tables.customers(spark, folder)
    text = text.withColumns({c: F.col(c).cast("string") for c in text.columns})
    number = F.col("customer_id").cast("bigint")
    flawed = text.withColumns(
        {
            "age": F.when(F.col("age").cast("bigint") % 8 == 0, F.concat("age", F.lit(" years"))).otherwise(F.col("age")),
            "total_purchases": F.when(number % 11 == 0, "many").when(number % 5 == 0, " ").otherwise(F.col("total_purchases")),
            "days_since_last_purchase": F.when(number % 6 == 1, "1O").otherwise(F.col("days_since_last_purchase")),
        }
    )
    cleaned, ledger = cleaning.clean_customers_with_ledger(flawed)
    rows = cleaned.select(F.col("customer_id").alias("id"), "age", "total_purchases", "days_since_last_purchase")
    return rows.join(ledger, "id", "left")


@query(
    "u4_log_duplicates",
    """SELECT round((sum(n) - count(*))::DOUBLE / sum(n) * 100, 6) AS duplicate_rate FROM (
      SELECT count(*) AS n FROM events GROUP BY ts::DATE, event_type, json_extract_string(props, '$.k'))""",
)
def log_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated entries of a day in the action log, whose details are a map."""
    log = tables.actions(spark, folder).select(F.to_date("timestamp").alias("day"), "action", "details")
    return six_digits(quality.duplicate_rate(log))


@query("t7_preview", f"WITH {CUST} SELECT {CUSTOMER_COLUMNS} FROM cust ORDER BY customer_id LIMIT 5")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return six_digits(reports.preview(tables.customers(spark, folder).orderBy("customer_id")))


@query(
    "fn_title_words",
    """SELECT p_partkey, array_to_string(list_transform(string_split(lower(replace(p_type, '_', ' ')), ' '),
      lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part""",
)
def title_words(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.table(spark, folder, "part")
    return parts.select("p_partkey", scalars.title_words(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("title"))


# ---- file round trips ----

@query(
    "s1_s4_csv_round_trip",
    """SELECT conv_id, turn::INTEGER AS turn, CASE WHEN turn % 5 = 0 OR turn % 7 = 1 THEN 'missing' ELSE md5(text) END AS digest
    FROM conversations""",
)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes and line breaks, some missing and some empty, exported as CSV and read again: an empty cell is missing."""
    talks = tables.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    holed = F.when(F.col("turn") % 5 != 0, F.when(F.col("turn") % 7 == 1, "").otherwise(F.col("text")))
    path = sinks.export_csv(talks.withColumn("text", holed), new_path(spark, "csv"), "talks")
    read = readers.read_table(spark, path, multi_line=True)
    digest = F.coalesce(F.md5("text"), F.lit("missing"))
    return read.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("int").alias("turn"), digest.alias("digest"))


@query(
    "s2_c16_retail_from_csv",
    f"""WITH {RAW}, cap AS (SELECT quantile_cont(total_amount, 0.999) AS q FROM sales)
    SELECT {SEASON.format('invoice_date')} AS season, count(*) AS lines, count(DISTINCT customer_id) AS customers,
    round(fsum(total_amount), 2) AS revenue FROM sales, cap WHERE total_amount <= q GROUP BY ALL""",
)
def retail_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Raw retail text exported as CSV, read, recognised and cleaned."""
    path = sinks.export_csv(tables.raw_retail(spark, folder), new_path(spark, "csv"), "retail")
    cleaned = pipeline.clean(readers.read_table(spark, path))
    summed = cleaned.groupBy("season").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("customer_id").alias("customers"), scalars.money_sum(F.col("total_amount")).alias("revenue")
    )
    return six_digits(summed, 2)


@query(
    "s5_s6_log_round_trip",
    """SELECT event_type AS feedback_type, CASE WHEN event_id % 7 <> 0 THEN 1 + event_id % 5 END::INTEGER AS rating,
    md5(props) AS digest, 'user' || user_id || '@example.com' AS user_email, true AS stamped FROM events""",
)
def log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback appended to a JSON log and read by its schema; ids and times are given by the log."""
    path = new_path(spark, "log")
    sinks.append_records(tables.feedback(spark, folder).drop("id", "timestamp"), path, schemas.FEEDBACK)
    read = readers.read_log(spark, path, schemas.FEEDBACK)
    stamped = F.col("id").isNotNull() & F.col("timestamp").isNotNull()
    return read.select("feedback_type", "rating", F.md5("feedback_text").alias("digest"), "user_email", stamped.alias("stamped"))
