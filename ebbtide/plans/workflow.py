"""The end-to-end jobs: prepare, train, score, explore."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.hashing import shuffle_key, unit_interval
from ebbtide.operators.assemble import assemble
from ebbtide.operators.clean import drop_columns, sentinel_to_null
from ebbtide.operators.encode import fit_levels, one_hot, ordinal_encode_mapped
from ebbtide.operators.impute import fit_medians, fit_modes, impute_median, impute_mode
from ebbtide.operators.scale import fit_scaler, scale
from ebbtide.operators.score import score_batch
from ebbtide.operators.split import fold_column, stratified_split
from ebbtide.operators.train import (
    Comparison, Settings, candidates, compare_models, deep_forest, fit_voting, gradient_boosting, second_order_boosting,
)
from ebbtide.plans.features import FeatureBuilder, FeatureModel
from ebbtide.schema import (
    BATCH_REQUIRED_COLUMNS, DROPPED_CATEGORICALS, DROPPED_COLUMNS_EXPLORE, ID, LABEL,
    NOMINAL_COLUMNS_DROP_FIRST, RAW_SCHEMA, numeric_fields, string_fields,
)
from ebbtide.sources.cells import PROBLEMS, read_checked
from ebbtide.sources.models import ModelSet, save_models
from ebbtide.sources.staging import spread, stage
from ebbtide.sources.tables import export_predictions, read_customers, write_split


class Prepared(NamedTuple):
    """Feature table with id, label, split, fold and sample key, and its fitted features."""

    table: DataFrame
    features: FeatureModel

    def vectors(self, part: str | None = None) -> DataFrame:
        rows = self.table if part is None else self.table.filter(F.col("split") == part)
        keep = [ID, LABEL, "split", "fold", "sample_key"]
        return assemble(rows, self.features.feature_names, keep=keep)


def prepare(customers: DataFrame, fit_on: str = "train", scaling: str = "all", folds: int = 5) -> Prepared:
    """Split, fit the features on the training rows and build the feature table.

    ``fit_on="all"`` fits medians and scales on all rows, before the split.
    """
    split = stratified_split(customers)
    # The folds divide the training rows, with a key of their own: with the split's key the
    # first fold would be the test set.
    folded = split.withColumns({
        "fold": fold_column(split.filter("split = 'train'"), folds, seed=43),
        "sample_key": unit_interval(shuffle_key(ID, 7)),
    })
    rows = folded if fit_on == "all" else folded.filter("split = 'train'")
    features = FeatureBuilder(scaling=scaling).fit(rows.drop("split", "fold", "sample_key"))
    return Prepared(features.features(folded, [ID, LABEL, "split", "fold", "sample_key"]), features)


class Trained(NamedTuple):
    models: ModelSet
    comparison: Comparison


def train(
    prepared: Prepared, settings: Settings = Settings(), folds: int = 5, select_by: str = "cv_f1"
) -> Trained:
    """Compare the classifiers, fit the vote and collect the model set."""
    train_rows, test_rows = prepared.vectors("train"), prepared.vectors("test")
    comparison = compare_models(
        train_rows, test_rows, candidates(train_rows.count(), settings), folds, select_by)
    if comparison.best is None:
        raise ValueError("no classifier reached a positive F1 score")
    voting = fit_voting(train_rows, [
        deep_forest(settings), gradient_boosting(settings), second_order_boosting(settings)], folds)
    models = ModelSet(prepared.features, comparison.models[comparison.best], voting.models)
    return Trained(models, comparison)


def prepare_and_train(
    spark: SparkSession, source: str, output: str, format: str = "csv",
    settings: Settings = Settings(), folds: int = 5,
) -> Trained:
    """Customer file in, split table and model set out."""
    raw = stage(spread(read_customers(spark, source, format)), "customers")
    prepared = prepare(raw, folds=folds)
    write_split(prepared.table, f"{output}/train_test")
    stored = prepared._replace(table=spark.read.parquet(f"{output}/train_test"))
    trained = train(stored, settings, folds)
    save_models(trained.models, f"{output}/models", spark)
    return trained


def score_file(
    spark: SparkSession, source: str, models: ModelSet, output: str, format: str = "csv", schema=None
) -> str:
    """Uploaded customer file in, CSV of predictions out.

    Cells of a delimited file that do not parse fail their row with their text and cause.
    """
    rows = read_checked(spark, source, schema or RAW_SCHEMA) if format == "csv" else read_customers(spark, source, format, schema)
    absent = [c for c in BATCH_REQUIRED_COLUMNS if c not in rows.columns]
    if absent:
        raise ValueError(f"columns missing in the batch: {absent}")
    return export_predictions(score_batch(rows, models, details=True).drop(PROBLEMS), output)


def explore_features(customers: DataFrame) -> tuple[DataFrame, list[str]]:
    """Feature table of the exploration: codes to NULL, imputed, coded, scaled.

    Keeps the id and the label unscaled beside the features.
    """
    kept = customers.withColumn("__id", F.col(ID))
    cleaned = sentinel_to_null(drop_columns(kept, DROPPED_COLUMNS_EXPLORE))
    numeric = [c for c in numeric_fields(cleaned.schema) if c not in (LABEL, "__id")]
    filled = impute_median(cleaned, fit_medians(cleaned, numeric))
    filled = impute_mode(filled, fit_modes(filled, string_fields(filled.schema)))
    coded = ordinal_encode_mapped(filled)
    levels = fit_levels(coded, NOMINAL_COLUMNS_DROP_FIRST, repair=False)
    coded = one_hot(coded, levels, repair=False, drop_first=True, keep_source=True)
    features = drop_columns(coded, DROPPED_CATEGORICALS)
    names = [c for c in features.columns if c not in (LABEL, "__id")]
    scaled = scale(features, fit_scaler(features, names))
    return scaled.withColumnRenamed("__id", ID), names
