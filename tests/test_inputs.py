"""Readers, writers, validation, batches, logs, generators and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cvengine.operators import batches, logs, quality
from cvengine.session import shared_folder
from cvengine.sources import generators, readers, schemas, sinks, tables
from cvengine.streaming import action_log


def test_csv_round_trip_and_spreadsheet_sibling(spark, tmp_path):
    (tmp_path / "sales.csv").write_bytes(b"customer_id,total_purchases,status\r\nc1,3,active \r\nc2,x,none\r\n")
    df = readers.read_table(spark, str(tmp_path / "sales.xlsx"))
    assert [tuple(r) for r in df.collect()] == [("c1", "3", "active "), ("c2", "x", "none")]
    path = sinks.export_csv(df, str(tmp_path), "out", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("out_20240102_030405")
    assert spark.read.csv(path, header=True).count() == 2


def test_parquet_json_and_frame(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "id string, v double")
    sinks.export_parquet(df, str(tmp_path / "t.parquet"))
    df.where("id = 'b'").write.json(str(tmp_path / "t.jsonl"))
    assert readers.read_table(spark, str(tmp_path / "t.parquet")).where("v is null").count() == 1
    assert readers.read_table(spark, str(tmp_path / "t.jsonl")).first()["v"] == 1.0
    assert readers.read_table(spark, df).where("v is null").count() == 1


def test_logs_append_and_read(spark, tmp_path):
    path = str(tmp_path / "feedback")
    assert readers.read_log(spark, path, schemas.FEEDBACK).count() == 0
    entry = spark.createDataFrame([("bug", 4, "text", "a@example.com")], "feedback_type string, rating int, feedback_text string, user_email string")
    sinks.append_records(entry, path, schemas.FEEDBACK)
    sinks.append_records(entry, path, schemas.FEEDBACK)
    back = readers.read_log(spark, path, schemas.FEEDBACK)
    assert back.select("id").distinct().count() == 2 and back.where("timestamp is null").count() == 0
    array = tmp_path / "requests.json"
    array.write_text(json.dumps([{"feature_title": "t", "status": "Pending", "timestamp": "2024-01-01T10:00:00"}], indent=2))
    assert readers.read_log(spark, str(array), schemas.FEATURE_REQUEST).first()["status"] == "Pending"


def test_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Session:
        sparkContext = Context()

    session = Session()
    session.conf = Conf(None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
    session.conf = Conf("hdfs:///shared/")
    assert shared_folder(session) == "hdfs:///shared"


def people(spark):
    rows = [
        ("a", 12, 1, 5.0, 10, 20),
        ("a", 30, -1, 5.0, 10, 5),
        ("b", 121, 1, 5.0, 10, 5),
        ("c", 40, 1, 5.0, 10, 5),
    ]
    names = "customer_id string, age int, total_purchases int, avg_order_value double, days_since_first_purchase int, days_since_last_purchase int"
    extra = {c: F.lit("x") for c in ("acquisition_channel", "location", "subscription_status")}
    return spark.createDataFrame(rows, names).withColumns(extra)


def test_validation(spark):
    found = quality.messages(quality.validate(people(spark)))
    assert found == {
        "errors": ["duplicate customer id", "last purchase before first", "negative total_purchases"],
        "warnings": ["unrealistic age"],
    }
    stopped = quality.messages(quality.validate(people(spark).drop("age")))
    assert stopped["errors"] == ["missing column age"]


def test_quality_score_equals_pandas(spark):
    rows = [(float(i % 10), i % 7) for i in range(60)] + [(500.0, 1), (None, 3), (None, 3)]
    df = spark.createDataFrame(rows, "v double, w int")
    for cell_rows in (1000, 9):
        got = quality.quality_score(df, cell_rows).first()
        frame = df.toPandas()
        complete = 100 - frame.isnull().sum().sum() / frame.size * 100
        repeated = frame.duplicated().sum() / len(frame) * 100
        outside = 0
        for c in frame:
            low, high = frame[c].quantile(0.25), frame[c].quantile(0.75)
            reach = 1.5 * (high - low)
            outside += ((frame[c] < low - reach) | (frame[c] > high + reach)).sum() / len(frame)
        outlying = outside / 2 * 100
        assert tuple(got) == pytest.approx((complete, repeated, outlying, complete * 0.6 - repeated * 0.2 - outlying * 0.2))


def test_batches(spark):
    known = people(spark).where("customer_id = 'c'")
    fresh = spark.createDataFrame([("d", 20)], "customer_id string, age int")
    assert batches.append_customers(known, fresh).where("customer_id = 'd' and location is null").count() == 1
    assert batches.remove_customers(people(spark), known).where("customer_id = 'c'").count() == 0
    checked = batches.check_new(
        people(spark).withColumn("customer_id", F.when(F.col("customer_id") == "b", " ").otherwise(F.concat("customer_id", F.lit(" ")))), known
    )
    assert batches.accepted(checked).count() == 0
    broken = {tuple(r["violations"]) for r in batches.rejected(checked).collect()}
    assert broken == {
        ("age outside 18 to 100", "last purchase before first"),
        ("negative purchases",),
        ("customer id is empty", "age outside 18 to 100"),
        ("customer id exists",),
    }


def test_log_summaries_default_to_now(spark):
    df = spark.sql("select current_timestamp() timestamp, 'x' action, '1' id union all select timestamp'2000-01-01', 'y', '2'")
    assert tuple(logs.action_summary(df).first()) == (2, 1)
    assert logs.most_recent(df, 1).first()["id"] == "1"


def test_generated_customers(spark):
    df = generators.sample_customers(spark, 500, "2024-06-01")
    bad = df.where(
        "days_since_first_purchase < 180 or days_since_first_purchase > 1095 or age < 18 or age > 80 "
        "or days_since_last_purchase > least(days_since_first_purchase, 540) or total_purchases not between 5 and 100 "
        "or avg_order_value not between 15 and 1000"
    )
    assert bad.count() == 0 and df.select("customer_id").distinct().count() == 500
    again = generators.sample_customers(spark, 500, "2024-06-01").repartition(3)
    assert df.exceptAll(again).count() == 0


def test_generated_transactions(spark):
    df = generators.sample_transactions(spark, 50, "2024-06-01")
    span = df.agg(F.date_diff(F.max("invoice_date"), F.min("invoice_date"))).first()[0]
    assert span >= 540
    assert df.where("invoice_date > '2024-06-01' or quantity < 1 or total_amount <= 0").count() == 0


def test_stream_equals_batch(spark, sf):
    closed = action_log.count_available(spark, f"{sf}/events*.parquet")
    batch = action_log.daily_counts(tables.actions(spark, sf))
    assert closed.exceptAll(batch).count() == 0
    missing = batch.exceptAll(closed).select("day").distinct().count()
    assert missing == 1  # only the day still open under the watermark


def test_intake_resumes(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    line = '{"timestamp": "2024-01-01T10:00:00", "action": "view", "details": {"k": "1"}, "session_id": "s", "id": "%s"}'
    spark.createDataFrame([(line % "1",), (line % "1",), ('{"id": broken',)], "value string").coalesce(1).write.text(source)
    assert action_log.run_available(action_log.intake(spark, source), sink, progress).count() == 1
    spark.createDataFrame([(line % "2",), (line % "1",)], "value string").coalesce(1).write.mode("append").text(source)
    assert action_log.run_available(action_log.intake(spark, source), sink, progress).count() == 2
