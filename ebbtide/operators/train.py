"""Classifier training, comparison, search and voting.

The assembled frame is persisted once (memory and disk) for all fits of a call.  Folds
are filters on that frame.  Trees and linear models are MLlib's distributed learners.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import product
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.assemble import FEATURES
from ebbtide.operators.boosting import HistBooster, binned_frame, booster_model, fit_many, staged_search
from ebbtide.operators.forest import DeepForest
from ebbtide.operators.evaluate import binary_scores, hard_vote, roc_auc
from ebbtide.schema import LABEL
from ebbtide.sources.staging import shared_dir, spread

SEED = 42


class Settings(NamedTuple):
    """Sizes of the learners; the defaults are those of a full training run."""

    trees: int = 100
    forest_depth: int = 12
    iterations: int = 100
    max_iter: int = 1000


def logistic_regression(rows: int, s: Settings = Settings()) -> Estimator:
    """L2 strength 1 on the sum of losses equals 1/rows on their mean."""
    return LogisticRegression(
        labelCol=LABEL, featuresCol=FEATURES, maxIter=s.max_iter, regParam=1.0 / max(rows, 1),
        standardization=False)


def random_forest(s: Settings = Settings()) -> Estimator:
    return RandomForestClassifier(
        labelCol=LABEL, featuresCol=FEATURES, numTrees=s.trees, maxDepth=s.forest_depth,
        minInstancesPerNode=1, seed=SEED, cacheNodeIds=True)


def deep_forest(s: Settings = Settings()) -> Estimator:
    """Forest whose trees grow until their leaves are pure."""
    return DeepForest(numTrees=s.trees, seed=SEED)


def gradient_boosting(s: Settings = Settings(), depth: int = 3, step: float = 0.1, subsample: float = 1.0) -> Estimator:
    return GBTClassifier(
        labelCol=LABEL, featuresCol=FEATURES, maxIter=s.iterations, maxDepth=depth, stepSize=step,
        subsamplingRate=subsample, featureSubsetStrategy="all", seed=SEED)


def second_order_boosting(s: Settings = Settings(), depth: int = 6, step: float = 0.3, subsample: float = 1.0) -> Estimator:
    return HistBooster(maxIter=s.iterations, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=SEED)


def candidates(rows: int, s: Settings = Settings()) -> dict[str, Estimator]:
    """The four compared classifiers: a linear one, a forest, and boosting of first and second order."""
    return {
        "Logistic Regression": logistic_regression(rows, s),
        "Random Forest": deep_forest(s),
        "Gradient Boosting": gradient_boosting(s),
        "XGBoost": second_order_boosting(s),
    }


@contextmanager
def persisted(df: DataFrame):
    """Keep a frame over several fits; partitions that are lost get recomputed."""
    shared_dir(df.sparkSession)  # boosting checkpoints its residuals there
    df = spread(df)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def predict(model: Model, df: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``<prefix>prediction`` and ``<prefix>probability`` of class 1.

    A model without probabilities gives the class as a double.
    """
    out = model.transform(df)
    has_probability = "probability" in out.columns
    probability = vector_to_array("probability")[1] if has_probability else F.col("prediction").cast("double")
    return out.select(
        *df.columns, F.col("prediction").cast("int").alias(f"{prefix}prediction"),
        probability.alias(f"{prefix}probability"))


def f1_score(model: Model, df: DataFrame) -> float:
    return binary_scores(predict(model, df), LABEL, "prediction").first()["f1"]


def auc_score(model: Model, df: DataFrame) -> float | None:
    return roc_auc(predict(model, df), LABEL, "probability").first()["auc"]


def _mean_std(values: list[float]) -> tuple[float, float]:
    mean = sum(values) / len(values)
    return mean, (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5


def cross_validate(
    estimator: Estimator, df: DataFrame, k: int, params: dict | None = None, fold_col: str = "fold", parallelism: int = 1
) -> list[float]:
    """F1 of class 1 on each held-out fold, ``parallelism`` fits at a time."""
    def score(i: int) -> float:
        model = estimator.fit(df.filter(F.col(fold_col) != i), params or {})
        return f1_score(model, df.filter(F.col(fold_col) == i))

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(score, range(k)))


class Comparison(NamedTuple):
    table: DataFrame
    models: dict[str, Model]
    best: str | None


def compare_models(
    train: DataFrame,
    test: DataFrame,
    estimators: dict[str, Estimator],
    k: int = 5,
    select_by: str = "cv_f1",
    parallelism: int = 4,
) -> Comparison:
    """Cross-validated and test scores per classifier, and the best of them.

    The folds of a classifier are fitted ``parallelism`` at a time: boosting has many short jobs.
    ``select_by="test_f1"`` picks on the test rows.  The first of equal scores wins, and a
    score of 0 never does.
    """
    rows, models, best, best_score = [], {}, None, 0.0
    with persisted(train) as train, persisted(test) as test:
        for name, estimator in estimators.items():
            mean, std = _mean_std(cross_validate(estimator, train, k, parallelism=parallelism))
            model = estimator.fit(train)
            test_f1, test_auc = f1_score(model, test), auc_score(model, test)
            rows.append((name, mean, std, test_f1, test_auc))
            models[name] = model
            score = mean if select_by == "cv_f1" else test_f1
            if score > best_score:
                best, best_score = name, score
    table = train.sparkSession.createDataFrame(
        rows, "model string, cv_f1_mean double, cv_f1_std double, test_f1 double, test_auc double")
    return Comparison(table, models, best)


FULL_GRID = {
    "maxIter": [100, 200],
    "maxDepth": [3, 5, 7],
    "stepSize": [0.01, 0.1, 0.3],
    "subsamplingRate": [0.8, 1.0],
}


class GridResult(NamedTuple):
    table: DataFrame
    best_params: dict
    best_score: float
    model: Model


def grid_search(
    train: DataFrame,
    grid: dict[str, list] = FULL_GRID,
    k: int = 5,
    parallelism: int = 4,
    estimator: Estimator | None = None,
) -> GridResult:
    """Cross-validated F1 of every setting of the grid, and a refit of the best one.

    The default learner is the second-order booster: all settings and folds share one binned
    frame, and settings that differ in the number of rounds only share a fit.  Another
    ``estimator`` is fitted per setting and fold, ``parallelism`` fits at a time.
    """
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    if estimator is None:
        binned = binned_frame(train, fold_col="fold")
        scores = [_mean_std(f) for f in staged_search(binned, settings, k, SEED)]
        best = max(range(len(settings)), key=lambda i: scores[i][0])
        fitted = fit_many(binned, [HistBooster(**settings[best], seed=SEED).spec()])[0]
        return GridResult(_grid_table(train, grid, settings, scores), settings[best], scores[best][0],
                          booster_model(fitted, binned.cuts))

    def run(setting: dict) -> tuple[float, float]:
        params = {estimator.getParam(p): v for p, v in setting.items()}
        return _mean_std(cross_validate(estimator, train, k, params))

    with persisted(train) as train:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(run, settings))
        best = max(range(len(settings)), key=lambda i: scores[i][0])
        model = estimator.fit(train, {estimator.getParam(p): v for p, v in settings[best].items()})
    return GridResult(_grid_table(train, grid, settings, scores), settings[best], scores[best][0], model)


def _grid_table(train: DataFrame, grid: dict, settings: list[dict], scores: list[tuple[float, float]]) -> DataFrame:
    columns = ", ".join(f"{p} double" for p in grid)
    return train.sparkSession.createDataFrame(
        [(*map(float, s.values()), mean, std) for s, (mean, std) in zip(settings, scores)],
        f"{columns}, cv_f1_mean double, cv_f1_std double")


def vote_with(models: Iterable[Model], df: DataFrame, out: str = "voting_prediction") -> DataFrame:
    """Hard vote of fitted models over one frame; there is no probability."""
    voted, names = df, []
    for i, model in enumerate(models):
        voted = predict(model, voted, f"__v{i}_")
        names.append(f"__v{i}_prediction")
    voted = hard_vote(voted, names, out)
    return voted.select(*df.columns, out)


class Voting(NamedTuple):
    models: list[Model]
    cv_f1_mean: float
    cv_f1_std: float


def fit_voting(train: DataFrame, members: list[Estimator], k: int = 5, fold_col: str = "fold") -> Voting:
    """Fit a hard-vote ensemble with its cross-validated F1."""
    scores = []
    with persisted(train) as train:
        for i in range(k):
            seen = train.filter(F.col(fold_col) != i)
            held = vote_with([m.fit(seen) for m in members], train.filter(F.col(fold_col) == i))
            scores.append(binary_scores(held, LABEL, "voting_prediction").first()["f1"])
        models = [m.fit(train) for m in members]
    return Voting(models, *_mean_std(scores))


def feature_importance(model: Model, feature_names: list[str], spark, top_n: int = 20) -> DataFrame:
    """Largest importances of a tree model, or absolute coefficients of a linear one.

    One value per feature, so the table is as small as the feature list.  A model that has
    neither gives an empty table.
    """
    schema = "feature string, importance double"
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        return spark.createDataFrame([], schema)
    rows = [(f, float(v)) for f, v in zip(feature_names, values)]
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature").limit(top_n)


def learning_curve(
    train: DataFrame,
    validation: DataFrame,
    estimator: Estimator,
    fractions: list[float] = (0.2, 0.4, 0.6, 0.8, 1.0),
    order_col: str = "sample_key",
) -> DataFrame:
    """Train and validation F1 on nested, growing samples of the training rows.

    ``order_col`` is a uniform number in [0, 1); a sample is a filter on it.
    """
    rows = []
    with persisted(train) as train, persisted(validation) as validation:
        for fraction in fractions:
            part = train if fraction >= 1 else train.filter(F.col(order_col) < fraction)
            model = estimator.fit(part)
            rows.append((float(fraction), part.count(), f1_score(model, part), f1_score(model, validation)))
    return train.sparkSession.createDataFrame(
        rows, "fraction double, n_train bigint, train_score double, validation_score double")


def fit_regressor(train: DataFrame, target: str, s: Settings = Settings()) -> Model:
    """Regressor of the customer value."""
    return RandomForestRegressor(
        labelCol=target, featuresCol=FEATURES, numTrees=s.trees, maxDepth=s.forest_depth,
        predictionCol="predicted_monetary", seed=SEED).fit(train)
