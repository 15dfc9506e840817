"""Enrichment, report tables and metrics on small frames."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cvengine.operators import bundle, metrics, reports, scoring, strategies
from cvengine.plans import pipeline
from cvengine.session import stage


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(f"c{i:03d}", float((i * 37) % 101) + 1, 20 + i % 50, "online" if i % 3 else "store") for i in range(100)]
    df = spark.createDataFrame(rows, "customer_id string, predicted_clv double, age int, acquisition_channel string")
    return stage(scoring.enrich(df))


@pytest.fixture(scope="module")
def expected(scored):
    frame = scored.select("customer_id", "predicted_clv").toPandas()
    clv = frame["predicted_clv"]
    frame["segment"] = pd.cut(
        clv,
        bins=clv.quantile([0, 0.2, 0.4, 0.6, 0.8, 1]).tolist(),
        labels=["Low Value", "Low-Medium", "Medium", "Medium-High", "High Value"],
        include_lowest=True,
    ).astype(str)
    frame["risk"] = 1 - clv / clv.max()
    frame["rank"] = clv.rank(pct=True) * 100
    frame["low"] = clv - 1.96 * clv.std()
    return frame.sort_values("customer_id")


def test_enrichment(scored, expected):
    got = scored.orderBy("customer_id").toPandas()
    assert got["customer_segment"].tolist() == expected["segment"].tolist()
    for ours, theirs in [("churn_risk", "risk"), ("percentile_rank", "rank"), ("confidence_lower", "low")]:
        assert got[ours].tolist() == pytest.approx(expected[theirs].tolist())


def test_summary_equals_pandas(scored, expected):
    got = reports.segment_summary(scored).toPandas().set_index("customer_segment")
    want = expected.groupby("segment")["predicted_clv"].agg(["count", "mean", "median", "std"]).round(2)
    for kind in want.columns:
        assert got[f"predicted_clv_{kind}"].to_dict() == pytest.approx(want[kind].to_dict(), abs=0.011)


def test_summary_with_split_groups(scored):
    whole = reports.segment_summary(scored, digits=None).orderBy("sort_order").collect()
    split = reports.segment_summary(scored, digits=None, cell_rows=6).orderBy("sort_order").collect()
    for a, b in zip(whole, split):
        assert a.asDict() == pytest.approx(b.asDict())


def test_shares_sum_to_hundred(scored):
    assert reports.segment_revenue(scored, None).agg(F.sum("percentage")).first()[0] == pytest.approx(100)


def test_empty_segment_is_listed(scored):
    table = reports.segment_summary(scored.where("customer_segment <> 'Medium'")).orderBy("sort_order").collect()
    assert [r["predicted_clv_count"] for r in table] == [20, 20, 0, 20, 20]


def test_repeated_edges(spark):
    df = stage(spark.createDataFrame([(f"c{i}", 1.0 if i < 8 else float(i)) for i in range(10)], "customer_id string, predicted_clv double"))
    with pytest.raises(ValueError, match="unique"):
        scoring.enrich(df)
    merged = {r["customer_id"]: r["customer_segment"] for r in scoring.enrich(df, on_ties="merge").collect()}
    assert merged["c0"] == "Low Value" and merged["c9"] == "High Value"
    with pytest.raises(ValueError, match="unique"):
        reports.tier_table(df.withColumn("churn_risk", F.lit(0.1)))


def test_concentration_with_ties(spark):
    values = [5.0] * 15 + [1.0] * 5
    df = stage(spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(values)], "customer_id string, predicted_clv double"))
    row = reports.revenue_concentration(df, cell_rows=4).first()
    assert (row[0], row[1]) == (10.0, pytest.approx(10 / 80 * 100))
    assert [r["customer_id"] for r in reports.top_tenth(df).orderBy("customer_id").collect()] == ["c0", "c1"]


def test_fewer_than_ten_customers(spark):
    df = stage(spark.createDataFrame([("a", 2.0), ("b", 1.0)], "customer_id string, predicted_clv double"))
    assert tuple(reports.revenue_concentration(df).first()) == (0.0, 0.0)
    assert reports.top_tenth(df).count() == 0


def test_quadrants(spark):
    rows = [("High Value", 0.1, 9.0), ("High Value", 0.3, 8.0), ("Low-Medium", 0.9, 1.0), ("Medium", 0.1, 5.0)]
    df = spark.createDataFrame(rows, "customer_segment string, churn_risk double, predicted_clv double")
    got = {r["strategy"]: r for r in strategies.recommendations(df).collect()}
    assert set(got) == {"retain_and_grow", "retention_focus", "win_back_or_let_go"}
    assert got["retention_focus"]["avg_clv"] == 8.0 and len(got["retain_and_grow"]["actions"]) == 5


def test_histogram_counts_everyone(scored):
    assert reports.histogram(scored, "predicted_clv", 20).agg(F.sum("count")).first()[0] == 100
    one = scored.where("customer_id = 'c001'")
    assert reports.histogram(one, "predicted_clv", 20).first()["count"] == 1


def test_rounded_display(scored):
    top = reports.top_customers(scored).collect()
    assert len(top) == 10 and top[0]["predicted_clv"] == 101.0 and top[0]["churn_risk_percent"] == 0.0


def test_filter(scored):
    kept = scoring.filter_results(scored, ["High Value"], 90.0, 0.05)
    assert kept.count() == scored.where("predicted_clv >= 90 and churn_risk <= 0.05").count() > 0


def test_report_bundle(scored):
    made = pipeline.describe(scored)
    assert {"channel_segment", "age_vs_clv", "confidence_intervals", "portfolio", "recommendations"} <= set(made)
    assert "location_clv" not in made
    assert all(t.limit(1).count() >= 0 for t in made.values())


def test_metrics_equal_pandas(spark):
    rows = [(f"c{i:02d}", float((i * 13) % 17) * (i % 3 > 0), float((i * 7) % 19)) for i in range(40)]
    frame = pd.DataFrame(rows, columns=["customer_id", "actual", "predicted"])
    for cell_rows in (1000, 6):
        got = metrics.evaluate(stage(spark.createDataFrame(frame)), cell_rows).first()
        error = frame["actual"] - frame["predicted"]
        positive = frame["actual"] > 0
        assert got["rmse"] == pytest.approx(math.sqrt((error**2).mean()))
        assert got["mae"] == pytest.approx(error.abs().mean())
        assert got["r2"] == pytest.approx(1 - (error**2).sum() / ((frame["actual"] - frame["actual"].mean()) ** 2).sum())
        assert got["mape"] == pytest.approx((error.abs() / frame["actual"])[positive].mean())
        assert got["ranking_correlation"] == pytest.approx(frame["actual"].rank().corr(frame["predicted"].rank()))
        tops = [set(frame.sort_values([c, "customer_id"], ascending=[False, True]).head(4)["customer_id"]) for c in ("actual", "predicted")]
        assert got["top_10_precision"] == len(tops[0] & tops[1]) / 4


def test_metrics_edge_cases(spark):
    df = stage(spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 2.0)], "customer_id string, actual double, predicted double"))
    row = metrics.evaluate(df).first()
    assert row["mape"] is None and row["top_10_precision"] == 0.0 and row["r2"] == 0.0


@pytest.mark.parametrize("cell_rows", [1_000_000, 30])
def test_bundle_equals_the_single_tables(spark, scored, cell_rows):
    """Every grouped table of the bundle has the rows that its own function finds."""
    extra = scored.withColumn("location", F.when(F.col("age") > 30, F.concat(F.lit("l"), F.col("age") % 4)))
    extra = stage(extra.withColumn("total_purchases", F.lit(5)))
    made = bundle.Bundle(extra, cell_rows=cell_rows)
    pairs = [
        (made.segment_summary(None), reports.segment_summary(extra, None)),
        (made.segment_metrics(None), reports.segment_metrics(extra, None)),
        (made.segment_comparison(None), reports.segment_comparison(extra, None)),
        (made.segment_revenue(None), reports.segment_revenue(extra, None)),
        (made.segment_counts(), reports.segment_counts(extra)),
        (made.tier_table(None), reports.tier_table(extra, None)),
        (made.channel_segments(), reports.channel_segments(extra)),
        (made.mean_value_by("location"), reports.mean_value_by(extra, "location")),
        (made.portfolio(), reports.portfolio(extra)),
        (made.risk_exposure(), reports.risk_exposure(extra)),
        (made.scatter_grid("age"), reports.scatter_grid(extra, "age")),
        (made.scatter_grid("total_purchases"), reports.scatter_grid(extra, "total_purchases")),
        *[(made.histogram(name), reports.histogram(extra, *at)) for name, at in bundle.HISTOGRAMS.items()],
    ]
    for ours, theirs in pairs:
        assert sorted(ours.columns) == sorted(theirs.columns)
        rows = [sorted(map(lambda r: [r[c] for c in sorted(theirs.columns)], df.collect()), key=repr) for df in (ours, theirs)]
        for a, b in zip(*rows, strict=True):
            assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)


def test_bundle_reads_the_customers_three_times(spark, scored, monkeypatch):
    """Ends and quantiles, the grouping sets, the medians; the tables themselves read what was staged."""
    seen = []
    for name in ("agg", "groupingSets"):
        real = getattr(type(scored), name)
        monkeypatch.setattr(type(scored), name, lambda self, *a, _r=real, _n=name, **k: seen.append(_n) or _r(self, *a, **k))
    made = bundle.Bundle(scored)
    assert seen.count("groupingSets") == 1 and len(seen) <= 3
    path = scored.inputFiles()[0].rsplit("/", 1)[0]
    for table in (made.segment_summary(), made.tier_table(), made.channel_segments(), made.portfolio(), made.scatter_grid("age")):
        assert path not in "".join(table.inputFiles())


def test_bundle_of_nothing(spark, scored):
    made = bundle.Bundle(stage(scored.limit(0)))
    assert made.segment_summary().count() == 5 and made.tier_table().count() == 4
    assert made.histogram("clv_distribution").count() == 0 and made.scatter_grid("age").count() == 0
