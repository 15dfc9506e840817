"""Spark ML preprocessing, the four regressors, the leaderboard and saved models."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from cvengine import fixed_values as fixed
from cvengine.functions.scalars import finite
from cvengine.operators.metrics import evaluate, fit_quality
from cvengine.operators.order import CELL_ROWS
from cvengine.plans.medians import MedianImputer
from cvengine.session import stage
from cvengine.sources.published import announce, digests, latest

log = logging.getLogger(__name__)

ID, LABEL = "customer_id", "label"
#: Rows of a partition of vectors at most, and at least where that leaves cores idle: a job on fewer is all overhead. Boosting
#: runs hundreds of small jobs, and each partition of a forest shuffles sums of all nodes, so there are no more than needed.
VECTOR_ROWS, LEAST_ROWS = 200_000, 1000


@dataclass
class TrainConfig:
    """Sizes, seeds and search grids. A grid lists the values tried per parameter."""

    seed: int = 42
    test_percent: int = 20
    folds: int = 2
    parallelism: int = 4
    ridge_alphas: tuple[float, ...] = (1.0,)
    forest_trees: tuple[int, ...] = (100,)
    forest_depths: tuple[int, ...] = (10,)
    forest_leaf_rows: tuple[int, ...] = (1,)
    boosting_rounds: tuple[int, ...] = (100,)
    boosting_rates: tuple[float, ...] = (0.1,)
    boosting_depths: tuple[int, ...] = (3,)
    models: tuple[str, ...] = ("Linear_Regression", "Ridge_Regression", "Random_Forest", "Gradient_Boosting")


def wide_search() -> TrainConfig:
    """The larger grids. Spark trees stop at depth 30, which stands for unlimited depth."""
    return TrainConfig(
        folds=3,
        ridge_alphas=(0.1, 1.0, 10.0),
        forest_trees=(100, 200),
        forest_depths=(10, 20, 30),
        forest_leaf_rows=(1, 2),
        boosting_rounds=(100, 200),
        boosting_rates=(0.05, 0.1),
        boosting_depths=(3, 5),
    )


def feature_columns(df: DataFrame, legacy_features: bool = False) -> list[str]:
    """Model inputs present in ``df``: those of a rollup, or those of customer summaries.

    ``legacy_features`` takes the rollup list as soon as any of its names occurs. Without
    any expected column all numeric columns are used.
    """
    rolled_up = "total_transactions" in df.columns or "unique_invoices" in df.columns
    shared = legacy_features and any(c in df.columns for c in fixed.TRANSACTION_FEATURES)
    expected = fixed.TRANSACTION_FEATURES if rolled_up or shared else fixed.CUSTOMER_FEATURES
    present = [c for c in expected if c in df.columns]
    if present:
        return present
    targets = ("predicted_clv", "clv_percentile")
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in targets]


def model_input(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """Id, typed features and optionally the label. Infinities become NULL and are imputed."""
    typed = [
        F.col(c).cast("string").alias(c) if c in fixed.CATEGORICAL_FEATURES else finite(F.col(c)).alias(c)
        for c in columns
    ]
    target = [F.col(label).cast("double").alias(LABEL)] if label else []
    return df.select(F.col(ID).cast("string").alias(ID), *typed, *target)


def mark_test(df: DataFrame, config: TrainConfig) -> DataFrame:
    """Split and folds by a hash of the id: stable under any partitioning or re-run."""

    def draw(seed: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ID))), 1, 8), 16, 10).cast("bigint")

    draw, fold = draw(config.seed) % 100, (draw(config.seed + 1) % config.folds).cast("int")
    return df.withColumns({"is_test": draw < config.test_percent, "fold": fold})


def fit_preprocessing(train: DataFrame, columns: list[str], cell_rows: int = CELL_ROWS) -> tuple[PipelineModel, list[str]]:
    """One-hot categories, imputation by exact medians, one vector, one scaled vector.

    Labels are indexed in descending order, so the slot to leave out, that of the
    alphabetically first label, is the last one. Unseen and missing labels are all zero.
    Any number of labels is taken: vectors stay sparse, since scaling does not centre them. The intercept takes
    up the shift, and no penalty falls on it, so the fitted values are those of centred inputs.
    """
    categorical = [c for c in columns if c in fixed.CATEGORICAL_FEATURES]
    numeric = [c for c in columns if c not in categorical]
    stages, vectors, names = [], [], []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages.append(MedianImputer(numeric, filled, cell_rows))
        vectors += filled
        names += numeric
    if categorical:
        sizes = train.agg(*[F.count_distinct(c).alias(c) for c in categorical]).first()
        categorical = [c for c in categorical if sizes[c] > 1]
    if categorical:
        indexer = StringIndexer(
            inputCols=categorical,
            outputCols=[f"{c}__index" for c in categorical],
            stringOrderType="alphabetDesc",
            handleInvalid="keep",
        ).fit(train)
        stages.append(indexer)
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}__index" for c in categorical],
                outputCols=[f"{c}__slots" for c in categorical],
                handleInvalid="keep",
                dropLast=True,
            )
        )
        for c, labels in zip(categorical, indexer.labelsArray):
            kept = list(range(len(labels) - 1))
            stages.append(VectorSlicer(inputCol=f"{c}__slots", outputCol=f"{c}__kept", indices=kept))
            vectors.append(f"{c}__kept")
            names += [f"{c}_{label}" for label in labels[:-1]]
    stages.append(VectorAssembler(inputCols=vectors, outputCol="features"))
    stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True))
    return Pipeline(stages=stages).fit(train), names


class RidgeRegression(LinearRegression):
    """Linear regression whose ``regParam`` is the penalty on the summed squared error of the rows it is fitted on.

    Spark divides that error by the row count and scales the penalty by the label deviation, hence the
    conversion, anew for each fold.
    """

    def _fit(self, dataset: DataFrame):
        rows, deviation = dataset.agg(F.count(F.lit(1)), F.stddev_pop(self.getLabelCol())).first()
        plain = LinearRegression(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), standardization=False)
        return plain.setElasticNetParam(0.0).setRegParam(self.getRegParam() * (deviation or 1.0) / max(rows, 1)).fit(dataset)


def regressors(config: TrainConfig) -> dict[str, tuple]:
    """Name -> (estimator, grid, takes scaled input)."""
    linear = LinearRegression(featuresCol="scaled", labelCol=LABEL, standardization=False)
    ridge = RidgeRegression(featuresCol="scaled", labelCol=LABEL)
    # where each row stands in each tree is kept from level to level, not found again from the root
    forest = RandomForestRegressor(labelCol=LABEL, featureSubsetStrategy="all", seed=config.seed, cacheNodeIds=True)
    boosting = GBTRegressor(labelCol=LABEL, seed=config.seed)
    return {
        "Linear_Regression": (linear, ParamGridBuilder().build(), True),
        "Ridge_Regression": (ridge, ParamGridBuilder().addGrid(ridge.regParam, list(config.ridge_alphas)).build(), True),
        "Random_Forest": (
            forest,
            ParamGridBuilder()
            .addGrid(forest.numTrees, list(config.forest_trees))
            .addGrid(forest.maxDepth, list(config.forest_depths))
            .addGrid(forest.minInstancesPerNode, list(config.forest_leaf_rows))
            .build(),
            False,
        ),
        "Gradient_Boosting": (
            boosting,
            ParamGridBuilder()
            .addGrid(boosting.maxIter, list(config.boosting_rounds))
            .addGrid(boosting.stepSize, list(config.boosting_rates))
            .addGrid(boosting.maxDepth, list(config.boosting_depths))
            .build(),
            False,
        ),
    }


LEADERBOARD = (
    "model string, best_params string, train_r2 double, test_r2 double, train_rmse double, test_rmse double, "
    "test_mae double, test_mape double, ranking_correlation double, top_10_precision double, "
    "cv_r2_mean double, cv_r2_std double, needs_scaling boolean"
)


@dataclass
class ClvModel:
    """Fitted preprocessing and regressors with their leaderboard."""

    preprocessing: PipelineModel
    columns: list[str]
    feature_names: list[str]
    models: dict[str, object]
    best_name: str
    performance: list[dict] = field(default_factory=list)
    failures: dict[str, str] = field(default_factory=dict)

    @property
    def best(self):
        return self.models[self.best_name]

    def leaderboard(self, spark: SparkSession) -> DataFrame:
        """At most one row per model."""
        return spark.createDataFrame([tuple(r.values()) for r in self.performance], LEADERBOARD)

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df`` with ``predicted_clv``: the input columns pass through, vectors do not stay."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"the model needs the columns {', '.join(missing)}; found {', '.join(df.columns)}")
        kept = [F.col(c) for c in df.columns if c != "predicted_clv"]
        inputs = {c: finite(F.col(c)) for c in self.columns if c not in fixed.CATEGORICAL_FEATURES}
        carried = df.withColumn("__row", F.struct(*kept))
        ready = self.preprocessing.transform(carried.withColumns(inputs))
        scored = self.models[name or self.best_name].transform(ready)
        return scored.select("__row.*", F.col("prediction").alias("predicted_clv"))

    def importance(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        """Tree importances, or absolute coefficients of scaled inputs, largest first."""
        model = self.models[name or self.best_name]
        values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
        rows = [(f, abs(float(v))) for f, v in zip(self.feature_names, values.toArray())]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )


#: The parameter whose smaller values are prefixes of its largest, per learner.
PREFIX_OF = {"Random_Forest": "numTrees", "Gradient_Boosting": "maxIter"}


def _r2_of_prefixes(model, valid: DataFrame, sizes: list[int]) -> dict[int, float]:
    """R2 on ``valid`` of the ensembles of the first ``sizes`` members of ``model``."""
    mean_squares = F.avg((F.col(LABEL) - F.col("prediction")) ** 2)
    spread = valid.agg(F.var_pop(LABEL)).first()[0] or 0.0

    def r2(error: float) -> float:
        return 1 - error / spread if spread else float("nan")

    if isinstance(model, GBTRegressionModel):
        errors = model.evaluateEachIteration(valid.select("features", LABEL), "squared")
        return {n: r2(errors[min(n, len(errors)) - 1]) for n in sizes}
    found = {}
    for n in sizes:
        if n >= model.getNumTrees:
            scored = model.transform(valid)
        else:
            scored = valid
            for i, tree in enumerate(model.trees[:n]):
                scored = tree.copy().setPredictionCol(f"tree_{i}").transform(scored)
            scored = scored.withColumn("prediction", sum((F.col(f"tree_{i}") for i in range(n)), F.lit(0.0)) / n)
        found[n] = r2(scored.agg(mean_squares).first()[0])
    return found


def search(name: str, estimator, grid: list[dict], train: DataFrame, folds: int, run: Callable) -> tuple[dict, list[float], object]:
    """(best point, its R2 per fold, the estimator refitted there on all of ``train``); ``run`` maps a function over tasks.

    An ensemble of few members is the beginning of a larger one, so of points that differ in that number only the
    largest is fitted, and its prefixes are scored; every (point, fold) is a task. With a single point the refit waits for
    no score and is a task beside them.
    """
    prefix = PREFIX_OF.get(name)
    families: dict[tuple, list[dict]] = {}
    for point in grid:
        rest = tuple(sorted((p.name, v) for p, v in point.items() if p.name != prefix))
        families.setdefault(rest, []).append(point)

    def size(point: dict) -> int:
        return next((v for p, v in point.items() if p.name == prefix), 0)

    def score(task: tuple) -> dict[tuple, float]:
        rest, fold = task
        points = families[rest]
        largest = max(points, key=size)
        model = estimator.copy(largest).fit(train.where(F.col("fold") != fold))
        valid = train.where(F.col("fold") == fold)
        sizes = sorted({size(p) for p in points})
        if len(sizes) > 1:
            return {(rest, n, fold): r2 for n, r2 in _r2_of_prefixes(model, valid, sizes).items()}
        value = RegressionEvaluator(labelCol=LABEL, metricName="r2").evaluate(model.transform(valid))
        return {(rest, sizes[0], fold): value}

    def work(task: tuple | None):
        return score(task) if task else estimator.copy(grid[0]).fit(train)

    refits = [None] if len(grid) == 1 else []
    done = run(work, refits + [(rest, fold) for rest in families for fold in range(folds)])
    scores: dict[tuple, float] = {}
    for found in done[len(refits) :]:
        scores |= found
    per_point = {
        (rest, size(point)): ([scores[rest, size(point), fold] for fold in range(folds)], point)
        for rest, points in families.items()
        for point in points
    }
    values, best = max(per_point.values(), key=lambda found: sum(found[0]))
    return best, values, done[0] if refits else estimator.copy(best).fit(train)


def vector_partitions(rows: int, cores: int) -> int:
    """One for each core, or as many times that as VECTOR_ROWS asks for; fewer where they would have under LEAST_ROWS."""
    return max(1, min(cores * -(-rows // (VECTOR_ROWS * cores)), rows // LEAST_ROWS))


def train_models(frame: DataFrame, columns: list[str], config: TrainConfig, cell_rows: int = CELL_ROWS) -> ClvModel:
    """Fit, search and evaluate every regressor. ``frame`` comes from ``model_input``.

    The vectors are staged once; every fit, fold and evaluation reads them from there. Models, points and folds share
    one pool of ``config.parallelism`` concurrent fits.
    """
    spark = frame.sparkSession
    marked = stage(mark_test(frame, config), "marked")
    rows = marked.count()
    preprocessing, names = fit_preprocessing(marked.where(~F.col("is_test")), columns, cell_rows)
    vectors = preprocessing.transform(marked).select(ID, "features", "scaled", LABEL, "is_test", "fold")
    ready = stage(vectors.repartition(vector_partitions(rows, spark.sparkContext.defaultParallelism), ID), "vectors")
    train, test = ready.where(~F.col("is_test")), ready.where("is_test")
    chosen = {n: r for n, r in regressors(config).items() if n in config.models}
    fits, comparisons = ThreadPool(config.parallelism), ThreadPool(max(1, len(chosen)))

    def run(function: Callable, tasks: list) -> list:
        return fits.map(inheritable_thread_target(spark)(function), tasks)

    def compare(name: str) -> tuple:
        estimator, grid, scaled = chosen[name]
        try:
            best, folds, model = search(name, estimator, grid, train, config.folds, run)
            pairs = [F.col(ID), F.col(LABEL).alias("actual"), F.col("prediction").alias("predicted")]
            on_train = fit_quality(model.transform(train).select(*pairs)).first()
            on_test = evaluate(stage(model.transform(test).select(*pairs), "predictions"), cell_rows).first()
        except Exception as error:  # one failing model does not end the comparison
            log.error("training %s failed: %s", name, error)
            return None, str(error)
        mean = sum(folds) / len(folds)
        return model, {
            "model": name,
            "best_params": json.dumps({p.name: v for p, v in sorted(best.items(), key=lambda x: x[0].name)}),
            "train_r2": on_train["r2"],
            "test_r2": on_test["r2"],
            "train_rmse": on_train["rmse"],
            "test_rmse": on_test["rmse"],
            "test_mae": on_test["mae"],
            "test_mape": 999.0 if on_test["mape"] is None else on_test["mape"],
            "ranking_correlation": on_test["ranking_correlation"],
            "top_10_precision": on_test["top_10_precision"],
            "cv_r2_mean": mean,
            "cv_r2_std": (sum((f - mean) ** 2 for f in folds) / len(folds)) ** 0.5,
            "needs_scaling": scaled,
        }

    try:
        results = dict(zip(chosen, comparisons.map(inheritable_thread_target(spark)(compare), list(chosen))))
    finally:
        fits.close()
        comparisons.close()
    models = {n: model for n, (model, _) in results.items() if model is not None}
    performance = [found for model, found in results.values() if model is not None]
    failures = {n: found for n, (model, found) in results.items() if model is None}
    if not performance:
        raise RuntimeError(f"no model could be trained: {failures}")
    best = max(performance, key=lambda r: r["test_r2"])["model"]
    return ClvModel(preprocessing, columns, names, models, best, performance, failures)


def save_model(model: ClvModel, spark: SparkSession, path: str) -> int:
    """Publish the model under ``path`` as its next version and return the number.

    Preprocessing and regressors are written to a folder of their own. The manifest, with the digest of every file, is announced
    last; until then readers see the version before, and a save that is killed leaves a folder nobody reads.
    """
    parts = f"parts/{uuid.uuid4().hex}"
    model.preprocessing.write().save(f"{path}/{parts}/preprocessing")
    for name, fitted in model.models.items():
        PipelineModel(stages=[fitted]).write().save(f"{path}/{parts}/models/{name}")
    manifest = {
        "parts": parts,
        "digests": digests(spark, f"{path}/{parts}"),
        "columns": model.columns,
        "feature_names": model.feature_names,
        "models": list(model.models),
        "best_name": model.best_name,
        "performance": model.performance,
    }
    number = latest(spark, f"{path}/versions")[0] + 1
    announce(spark, f"{path}/versions", number, manifest)
    return number


def load_model(spark: SparkSession, path: str) -> ClvModel:
    """The last published version; a file that is missing or differs from the manifest is an error."""
    number, manifest = latest(spark, f"{path}/versions")
    if not number:
        raise ValueError(f"no model has been published under {path}")
    parts = f"{path}/{manifest['parts']}"
    present = digests(spark, parts)
    wrong = sorted(f for f, digest in manifest["digests"].items() if present.get(f) != digest)
    if wrong:
        raise ValueError(f"version {number} of the model is damaged: {', '.join(wrong[:5])}")
    models = {n: PipelineModel.load(f"{parts}/models/{n}").stages[0] for n in manifest["models"]}
    return ClvModel(
        PipelineModel.load(f"{parts}/preprocessing"),
        manifest["columns"],
        manifest["feature_names"],
        models,
        manifest["best_name"],
        manifest["performance"],
    )
