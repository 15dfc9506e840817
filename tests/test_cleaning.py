import pytest
from pyspark.sql import functions as F

from cvengine.functions import scalars
from cvengine.operators import cleaning
from cvengine.plans import pipeline


def customers(spark, **changes):
    row = {
        "customer_id": "c1",
        "total_purchases": "3",
        "avg_order_value": "10.5",
        "days_since_first_purchase": "100",
        "days_since_last_purchase": "20",
    }
    return spark.createDataFrame([{**row, **changes}])


def test_headers_and_aliases(spark):
    df = spark.createDataFrame([("c1", "3", "10", "5", "9")], [" CustomerID ", "Purchase Count", "Avg Spend", "Recency Days", "First Purchase Days"])
    cleaned = cleaning.clean_customers(df)
    assert {"customer_id", "avg_order_value", "days_since_last_purchase"} <= set(cleaned.columns)
    assert cleaned.first()["age"] == 35


def test_two_headers_for_one_name(spark):
    df = spark.createDataFrame([("a", "b")], ["channel", "source"])
    with pytest.raises(ValueError, match="acquisition_channel"):
        cleaning.apply_aliases(df)


def test_missing_required_columns(spark):
    with pytest.raises(ValueError, match="total_purchases"):
        cleaning.clean_customers(spark.createDataFrame([("c1",)], ["customer_id"]))
    with pytest.raises(ValueError, match="similar to invoice_date"):
        cleaning.require_retail(spark.createDataFrame([("1",)], ["the_invoicedate_text"]))


def test_coercion_clamp_and_defaults(spark):
    row = cleaning.clean_customers(
        customers(spark, total_purchases="abc", days_since_last_purchase="900", location=" urban ")
    ).first()
    assert row["total_purchases"] == 0.0
    assert row["days_since_last_purchase"] == 100.0
    assert row["location"] == "urban"
    assert (row["acquisition_channel"], row["subscription_status"]) == ("Unknown", "None")


def retail(spark):
    rows = [
        ("i1", "s1", "2", "2011-03-05 23:00:00", "1.5", "c1"),
        ("i2", "s1", "-1", "2011-03-06 01:00:00", "1.5", "c1"),
        ("i3", "s2", "1", "2011-03-06 01:00:00", "0", "c1"),
        ("i4", "s2", "1", "not-a-date", "3", "c2"),
        ("i5", "s2", "1", "2011-12-06 10:00:00", "3", None),
        ("i6", "s3", "4", "2011-12-04 10:30:00", "2.5", "c2"),
        ("i7", "s3", "1000", "2011-12-04 10:30:00", "99", "c2"),
    ]
    return spark.createDataFrame(rows, ["Invoice", "StockCode", "Quantity", "InvoiceDate", "Price", "Customer ID"])


def test_transaction_cleaning(spark):
    rows = {r["invoice"]: r for r in cleaning.clean_transactions(retail(spark)).collect()}
    assert set(rows) == {"i1", "i6"}  # i7 lies above the 99.9 % quantile
    first, second = rows["i1"], rows["i6"]
    assert (first["total_amount"], first["day_of_week"], first["hour"], first["is_weekend"]) == (3.0, 5, 23, 1)
    assert (first["season"], second["season"]) == ("Spring", "Winter")
    assert (second["year"], second["month"], second["quarter"]) == (2011, 12, 4)


def test_kind_detection(spark):
    assert cleaning.is_transactional(pipeline.clean(retail(spark)))
    assert not cleaning.is_transactional(pipeline.clean(customers(spark)))


def test_whole_days_are_elapsed_days(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 23:00:00' a, timestamp_ntz'2024-01-02 01:00:00' b")
    assert df.select(scalars.whole_days(F.col("a"), F.col("b"))).first()[0] == 0


def test_text_and_display_functions(spark):
    df = spark.createDataFrame([("a  <b>\n c", 1234.5, 0.12345, "win_back")], "t string, v double, p double, s string")
    shown = df.select(
        scalars.clean_text(F.col("t")),
        scalars.currency(F.col("v")),
        scalars.percent(F.col("p")),
        scalars.title_words(F.col("s")),
        scalars.currency(F.lit(None).cast("double")),
        scalars.currency(F.lit(-5.0)),
        scalars.half_even(F.lit(0.125), 2),
    ).first()
    assert tuple(shown) == ("a &lt;b&gt; c", "$1,234.50", "12.35%", "Win Back", "N/A", "$-5.00", 0.12)


def test_empty_text(spark):
    df = spark.createDataFrame([(None,), ("   \t ",)], "t string")
    assert [r[0] for r in df.select(scalars.clean_text(F.col("t"))).collect()] == ["", ""]


def test_non_finite_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (2.0,)], "v double")
    assert [r[0] for r in df.select(scalars.finite(F.col("v"))).collect()] == [None, None, 0.0, 2.0]


def test_ledger_of_rejected_cells(spark):
    rows = [("a", "12", "3", "1.5", "10", "2", "2024-01-01"), ("b", "x", "", None, "1e999", " 7 ", "soon"), ("c", None, "two", "NaN", "5", "9", " ")]
    names = "Customer ID,age,total_purchases,avg_order_value,days_since_first_purchase,days_since_last_purchase,invoice_date".split(",")
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    cleaned, ledger = cleaning.clean_customers_with_ledger(df)
    got = sorted((r["id"], r["column"], r["raw"], r["becomes"]) for r in ledger.collect())
    assert got == [
        ("b", "age", "x", "missing"),
        ("b", "days_since_first_purchase", "1e999", "zero"),
        ("b", "invoice_date", "soon", "dropped row"),
        ("c", "avg_order_value", "NaN", "zero"),
        ("c", "total_purchases", "two", "zero"),
    ]
    assert sorted(cleaned.collect()) == sorted(cleaning.clean_customers(df).select(cleaned.columns).collect())


def test_ledger_of_typed_input_is_empty(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3, 4)], "customer_id string, total_purchases long, avg_order_value double, days_since_first_purchase long, days_since_last_purchase long")
    cleaned, ledger = cleaning.clean_customers_with_ledger(df)
    assert ledger.count() == 0 and cleaned.count() == 1


def test_duplicates_of_any_type(spark):
    from cvengine.operators import quality

    schema = "m map<string,map<int,double>>, a array<string>, x double, t timestamp, s struct<p:float,q:string>"
    import datetime as dt

    at, later = dt.datetime(2024, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 2)
    nan = float("nan")
    rows = [
        ({"a": {1: 0.0}, "b": None}, ["x", None], 0.0, at, (nan, None)),
        ({"b": None, "a": {1: -0.0}}, ["x", None], -0.0, at, (nan, None)),
        ({"b": None, "a": {1: 0.0}}, [None, "x"], 0.0, at, (nan, None)),
        ({"b": None, "a": {1: 0.0}}, ["x", None], 0.0, later, (nan, None)),
        ({"b": None, "a": {1: 0.0}}, ["x", None], 0.0, at, None),
        (None, None, None, None, (None, None)),
        (None, None, None, None, None),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert quality.duplicate_rate(df).first()[0] == 25.0
    variants = spark.sql("""SELECT parse_json(x) AS v FROM VALUES ('{"a":1,"b":2}'), ('{"b":2,"a":1}'), ('[1]') AS t(x)""")
    assert abs(quality.duplicate_rate(variants).first()[0] - 100 / 3) < 1e-9
    assert quality.duplicate_rate(df.limit(0)).first()[0] is None
