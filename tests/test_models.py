import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cvengine.plans import modeling, pipeline
from cvengine.session import stage
from cvengine.sources import generators

CONFIG = modeling.TrainConfig()


@pytest.fixture(scope="module")
def customers(spark):
    return generators.sample_customers(spark, 300, "2024-06-01").drop("invoice_date").cache()


@pytest.fixture(scope="module")
def fitted(spark, customers):
    return pipeline.fit_pipeline(spark, customers, CONFIG)


def test_one_hot_drops_first_label_and_zeroes_unseen(spark):
    rows = [("1", "b", 1.0), ("2", "a", None), ("3", "c", 3.0), ("4", "a", float("inf"))]
    df = spark.createDataFrame(rows, "customer_id string, location string, age double")
    ready = modeling.model_input(df, ["age", "location"])
    fit, names = modeling.fit_preprocessing(ready, ["age", "location"])
    assert names == ["age", "location_c", "location_b"]
    probe = spark.createDataFrame([("5", "z", 2.0), ("6", None, None), ("7", "b", 9.0)], df.schema)
    vectors = [r[0].toArray().tolist() for r in fit.transform(modeling.model_input(probe, ["age", "location"])).orderBy("customer_id").select("features").collect()]
    assert vectors == [[2.0, 0.0, 0.0], [2.0, 0.0, 0.0], [9.0, 0.0, 1.0]]


def test_split_is_stable(customers):
    a = modeling.mark_test(customers, CONFIG).where("is_test").select("customer_id")
    b = modeling.mark_test(customers.repartition(7), CONFIG).where("is_test").select("customer_id")
    assert a.exceptAll(b).count() == 0 and 30 < a.count() < 90


def test_leaderboard_beats_the_mean(spark, fitted):
    rows = fitted.leaderboard.collect()
    assert [r["model"] for r in rows] == list(CONFIG.models)
    assert max(r["test_r2"] for r in rows) > 0.5
    assert fitted.model.best_name == max(rows, key=lambda r: r["test_r2"])["model"]


def test_run_yields_insights(fitted):
    assert fitted.insights["segment_analysis"].count() == 5
    assert fitted.insights["model_performance"].first()["r2"] == pytest.approx(
        max(p["test_r2"] for p in fitted.model.performance)
    )
    assert fitted.importance.first()["feature"] in ("total_purchases", "avg_order_value")


def test_saved_model_predicts_the_same(spark, fitted, customers, tmp_path):
    modeling.save_model(fitted.model, spark, str(tmp_path / "model"))
    loaded = modeling.load_model(spark, str(tmp_path / "model"))
    assert loaded.performance == fitted.model.performance
    for name in fitted.model.models:
        a = fitted.model.predict(customers, name).select("customer_id", "predicted_clv")
        b = loaded.predict(customers, name).select("customer_id", "predicted_clv")
        assert a.exceptAll(b).count() == 0
    scored = pipeline.score(customers, loaded)
    assert {"customer_segment", "churn_risk", "percentile_rank", "location"} <= set(scored.columns)
    assert pipeline.describe(scored, loaded)["feature_importance"].count() == 10


def test_transaction_run(spark):
    sales = generators.sample_transactions(spark, 120, "2024-06-01").drop("total_amount")
    run = pipeline.fit_pipeline(
        spark, sales, modeling.TrainConfig(models=("Ridge_Regression",), ridge_alphas=(0.1, 10.0)), on_ties="merge"
    )
    assert "regParam" in run.leaderboard.first()["best_params"]
    assert len(run.model.feature_names) == 35


def test_failing_model_is_skipped(spark, customers):
    bad = modeling.TrainConfig(models=("Linear_Regression", "Random_Forest"), forest_trees=(2,), forest_depths=(99,))
    table = pipeline.training_table(pipeline.clean(customers))
    columns = modeling.feature_columns(table)
    model = modeling.train_models(modeling.model_input(table, columns, "predicted_clv"), columns, bad)
    assert list(model.models) == ["Linear_Regression"]


def test_feature_lists(spark, customers):
    assert modeling.feature_columns(customers)[0] == "age" and len(modeling.feature_columns(customers)) == 8
    legacy = modeling.feature_columns(customers, legacy_features=True)
    assert legacy == ["avg_order_value", "days_since_last_purchase"]
    other = spark.createDataFrame([(1, 2.0, "x")], "a int, predicted_clv double, s string")
    assert modeling.feature_columns(other) == ["a"]


def test_any_number_of_categories(spark):
    rows = [(str(i), f"place {i % 1500}", float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "customer_id string, location string, age double")
    ready = modeling.model_input(df, ["age", "location"], "age")
    fit, names = modeling.fit_preprocessing(ready, ["age", "location"])
    assert len(names) == 1500
    vector = fit.transform(ready).select("scaled").first()[0]
    assert vector.size == 1500 and len(vector.indices) <= 2


def test_ridge_penalty_follows_the_rows(spark):
    """X'r = alpha * b holds for the coefficients of centred inputs."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    order = np.random.default_rng(0)
    x = order.standard_normal((80, 3)) + 5
    y = x @ [1.0, -2.0, 0.5] + order.standard_normal(80)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["scaled", "label"])
    ridge = modeling.RidgeRegression(featuresCol="scaled", labelCol="label").setRegParam(7.0).setTol(1e-12).setMaxIter(500)
    fitted = ridge.fit(df)
    b = fitted.coefficients.toArray()
    residual = y - x @ b - fitted.intercept
    assert np.allclose((x - x.mean(axis=0)).T @ residual, 7.0 * b, rtol=1e-3, atol=1e-2)


def test_missing_inputs_are_named(fitted, customers):
    with pytest.raises(ValueError, match="age"):
        fitted.model.predict(customers.drop("age"))


def test_prefixes_equal_smaller_ensembles(spark, customers):
    """The first rounds of boosting are the smaller ensemble; the first trees of a forest are their mean."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    table = customers.withColumn("predicted_clv", F.col("total_purchases") * F.col("avg_order_value"))
    ready = modeling.model_input(table, ["total_purchases", "avg_order_value"], "predicted_clv")
    fit, _ = modeling.fit_preprocessing(ready, ["total_purchases", "avg_order_value"])
    vectors = fit.transform(ready).select("customer_id", "features", "label").cache()
    judge = RegressionEvaluator(labelCol="label", metricName="r2")
    large = GBTRegressor(labelCol="label", seed=1, maxIter=6, maxDepth=2).fit(vectors)
    found = modeling._r2_of_prefixes(large, vectors, [3, 6])
    for rounds in (3, 6):
        small = GBTRegressor(labelCol="label", seed=1, maxIter=rounds, maxDepth=2).fit(vectors)
        assert found[rounds] == pytest.approx(judge.evaluate(small.transform(vectors)))
    forest = RandomForestRegressor(labelCol="label", seed=1, numTrees=5, maxDepth=3).fit(vectors)
    found = modeling._r2_of_prefixes(forest, vectors, [2, 5])
    assert found[5] == pytest.approx(judge.evaluate(forest.transform(vectors)))
    rows = vectors.collect()
    mean = [sum(t.predict(r["features"]) for t in forest.trees[:2]) / 2 for r in rows]
    actual = [r["label"] for r in rows]
    centre = sum(actual) / len(actual)
    want = 1 - sum((a - m) ** 2 for a, m in zip(actual, mean)) / sum((a - centre) ** 2 for a in actual)
    assert found[2] == pytest.approx(want)


def test_partitions_are_as_many_as_cores():
    """Up to VECTOR_ROWS rows each; before, they grew by one for every 50,000 rows."""
    assert [modeling.vector_partitions(n, 12) for n in (0, 999, 5000, 900_000, 2_400_000, 5_400_000)] == [1, 1, 5, 12, 12, 36]


def test_sole_point_is_refitted_beside_its_folds(spark):
    """With one point the fit on all rows is a task of the same batch as the folds, and forests keep the rows' places in trees."""
    rows = spark.range(400).selectExpr("double(id % 7) AS a", "double(id % 7) * 2 + double(id % 3) AS label", "int(id % 2) AS fold")
    ready = stage(VectorAssembler(inputCols=["a"], outputCol="features").transform(rows))
    estimator, grid, _ = modeling.regressors(modeling.TrainConfig(forest_trees=(3,), forest_depths=(3,)))["Random_Forest"]
    batches = []

    def run(function, tasks):
        batches.append(len(tasks))
        return [function(t) for t in tasks]

    best, values, model = modeling.search("Random_Forest", estimator, grid, ready, 2, run)
    assert batches == [3] and len(values) == 2 and best == grid[0] and estimator.getCacheNodeIds()
    again = estimator.copy(best).setCacheNodeIds(False).fit(ready)
    assert model.featureImportances == again.featureImportances and model.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:]


def test_training_on_more_rows_than_a_cell(spark):
    """33 numeric inputs whose medians are selected, as beyond a million customers: before, planning that took gigabytes of the driver."""
    import random

    order, names = random.Random(9), [f"c{i}" for i in range(33)]
    rows = [(f"id{i}", *[None if order.random() < 0.1 else order.uniform(0, 10) for _ in names]) for i in range(240)]
    df = spark.createDataFrame(rows, "customer_id string, " + ", ".join(f"{c} double" for c in names))
    table = df.withColumn("predicted_clv", F.coalesce(F.col("c0"), F.lit(5.0)) * 3 + F.coalesce(F.col("c1"), F.lit(5.0)))
    config = modeling.TrainConfig(models=("Linear_Regression",))
    model = modeling.train_models(modeling.model_input(table, names, "predicted_clv"), names, config, cell_rows=50)
    assert [r["model"] for r in model.leaderboard(spark).collect()] == list(config.models) and not model.failures
    train = modeling.mark_test(df, config).where(~F.col("is_test")).toPandas()
    assert model.preprocessing.stages[0].getMedians() == pytest.approx([train[c].median() for c in names])
