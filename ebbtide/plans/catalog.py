"""Every registered query: a function of (session, folder of the input tables).

All queries read the customer table that Spark derives from the whole input tables.  It is
written once per application and folder, as a production job would keep it, and every
query prunes and filters that table; ``customers`` itself is the derivation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import fixtures
from ebbtide.functions import risk
from ebbtide.functions.features import ENGINEERED_COLUMNS, engineer_features
from ebbtide.functions.text import literal, name
from ebbtide.operators import (
    clean, cluster, correlation, encode, evaluate, impute, levels, neighbours, pca, profile, report,
    scale, silhouette, smote, split, train, validate, wide_pca,
)
from ebbtide.operators.align import align_features
from ebbtide.operators.assemble import assemble
from ebbtide.operators.profiles import risk_profiles as profile_rows
from ebbtide.operators.score import score_batch
from ebbtide.plans import workflow
from ebbtide.plans.features import FeatureBuilder
from ebbtide.schema import (
    ID, LABEL, NOMINAL_COLUMNS, NUMERIC_COLUMNS, ORDINAL_CODES, ORDINAL_LEVELS, RAW_SCHEMA,
    REQUEST_FIELDS, SENTINELS, string_fields,
)
from ebbtide.sources import cells
from ebbtide.sources import models as model_store
from ebbtide.sources import tables
from ebbtide.sources.staging import new_path, spread, stage, stage_once
from ebbtide.streaming.scoring import read_results, score_stream

Query = Callable[[SparkSession, str], DataFrame]

# Small learners: a query shows the whole path in seconds; the library defaults are the
# full sizes.
SMALL = train.Settings(trees=10, forest_depth=5, iterations=5, max_iter=20)
FOLDS = 2

WIDE_COLUMNS = ["LastLoginIP", "RegistrationDate"]
ALIGN_NAMES = ["Recency", "Frequency", "NotInTheTable", "MonetaryTotal", "Gender_M"]


def customer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, f"customers:{sf_dir}", lambda: fixtures.customers(spark, sf_dir))


def given_scores(customers: DataFrame) -> DataFrame:
    """Label with scores and votes made of plain columns, many ties and some gaps."""
    raw = F.least("Recency", F.lit(700)) + (F.col(ID) * 37) % 301
    s = raw.cast("double") / 1000

    def flag(hit: Column) -> Column:
        return F.when(hit, 1).otherwise(0)

    p = F.when(F.col(ID) % 97 != 0, s)
    return customers.select(
        F.col(ID), F.col(LABEL).alias("y_true"), s.alias("y_score"), p.alias("p"),
        flag(s >= 0.5).alias("y_pred"), flag(s >= 0.4).alias("v1"), flag(s >= 0.5).alias("v2"),
        flag((F.col(ID) % 7 == 0) | (s >= 0.6)).alias("v3"))


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_scores(customer_table(spark, sf_dir))


_prepared: dict[tuple[str, str, int], workflow.Prepared] = {}


def prepared(spark: SparkSession, sf_dir: str, folds: int = FOLDS) -> workflow.Prepared:
    """Feature table of the training queries, written once per application, folder and folds."""
    key = (spark.sparkContext.applicationId, sf_dir, folds)
    if key not in _prepared:
        built = workflow.prepare(customer_table(spark, sf_dir), folds=folds)
        _prepared[key] = built._replace(table=stage(spread(built.table), "features"))
    return _prepared[key]


def _explored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    features, names = workflow.explore_features(customer_table(spark, sf_dir))
    return stage(spread(assemble(features, names, keep=[ID, LABEL])), "explored"), names


def _classifier(spark: SparkSession, sf_dir: str) -> model_store.ModelSet:
    ready = prepared(spark, sf_dir)
    rows = ready.vectors("train")
    model = train.logistic_regression(rows.count(), SMALL).fit(rows)
    return model_store.ModelSet(ready.features, model)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits: compare rounded."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(name(c)), places) for c in doubles})


def _melted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(CustomerID, feature, value) of 0/1 columns whose names depend on the data."""
    return df.unpivot([ID], columns, "feature", "value")


# --- sources and sinks ------------------------------------------------------------------

def scan_customers(spark, d):
    path = new_path(spark, "customers_csv")
    customer_table(spark, d).write.option("header", True).csv(path)
    return tables.read_customers(spark, path)


def roundtrip_processed(spark, d):
    customers = customer_table(spark, d)
    model = FeatureBuilder(scaling="none").fit(customers)
    path = new_path(spark, "processed")
    tables.write_processed(model.features(customers, [ID, LABEL]), path)
    stored = tables.read_processed(spark, path)
    numeric = [c for c in model.feature_names if c in (*NUMERIC_COLUMNS, *ENGINEERED_COLUMNS, *ORDINAL_LEVELS)]
    dummies = [c for c in model.feature_names if c not in numeric]
    hot = ", ".join(f"CASE WHEN {name(c)} = 1 THEN {literal(c)} END" for c in dummies)
    return stored.selectExpr(
        ID, LABEL, *[name(c) for c in numeric], f"concat_ws(',', {hot}) AS hot")


def train_test_read(spark, d):
    path = new_path(spark, "train_test")
    tables.write_split(split.stratified_split(customer_table(spark, d)), path)
    return tables.read_split(spark, path, "test").select(ID, LABEL, "MonetaryTotal")


def model_roundtrip(spark, d):
    models = _classifier(spark, d)
    path = new_path(spark, "models")
    model_store.save_models(models, path, spark)
    again = model_store.load_models(path, spark)
    customers = customer_table(spark, d)
    before = score_batch(customers, models).select(ID, F.col("churn_probability").alias("a"))
    after = score_batch(customers, again).select(ID, F.col("churn_probability").alias("b"))
    return before.join(after, ID).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("mismatches"))


def export_predictions(spark, d):
    """Predictions out as CSV and in again."""
    path = tables.export_predictions(_banded(spark, d), new_path(spark, "predictions"))
    return tables.read_customers(
        spark, path, schema=f"{ID} long, churn_prediction int, churn_probability double, churn_risk_level string")


def spoilt_lines(customers: DataFrame) -> DataFrame:
    """Customers as delimited lines, some with a bad cell, a cell too many or three too few."""
    i = F.col(ID)
    texts = customers.select(*[F.col(c).cast("string").alias(c) for c in RAW_SCHEMA.names]).withColumns({
        "Age": F.when(i % 11 == 0, "abc").otherwise(F.col("Age")),
        "UniqueProducts": F.when(i % 13 == 0, "12.5").otherwise(F.col("UniqueProducts"))})
    columns, quoted = [F.col(c) for c in RAW_SCHEMA.names], {"escape": '"'}
    return texts.select(
        F.when(i % 17 == 0, F.to_csv(F.struct(*columns, F.lit("extra").alias("extra")), quoted))
        .when(i % 19 == 0, F.to_csv(F.struct(*columns[:-3]), quoted)).otherwise(F.to_csv(F.struct(*columns), quoted)).alias("value"))


def malformed_cells(spark, d):
    """Rows of a file with bad cells: which were scored, and what was wrong with the others."""
    path = new_path(spark, "spoilt")
    spoilt_lines(customer_table(spark, d)).write.text(path)
    scored = score_batch(cells.read_checked(spark, path, RAW_SCHEMA, header=False), _classifier(spark, d))
    return scored.select(ID, "success", F.array_join(cells.problem_texts(), "; ").alias("problems"))


# --- profiling --------------------------------------------------------------------------

def class_distribution_by_split(spark, d):
    return profile.class_distribution(split.stratified_split(customer_table(spark, d)), by="split")


def box_stats(spark, d):
    return profile.box_stats(clean.sentinel_to_null(customer_table(spark, d)))


def duplicate_rows(spark, d):
    return profile.duplicate_rows(customer_table(spark, d).drop(ID))


def duplicate_rows_attributes(spark, d):
    """Rows that repeat on a few coarse columns: many groups of copies."""
    return profile.duplicate_rows(customer_table(spark, d).select(*ORDINAL_LEVELS, "Gender"))


# --- projections ------------------------------------------------------------------------

def sentinel_to_null(spark, d):
    return clean.sentinel_to_null(customer_table(spark, d)).select(ID, *SENTINELS)


def ordinal_encode(spark, d):
    return encode.ordinal_encode(customer_table(spark, d)).select(ID, *ORDINAL_LEVELS)


def ordinal_encode_mapped(spark, d):
    return encode.ordinal_encode_mapped(customer_table(spark, d)).select(
        ID, *[f"{c}_encoded" for c in ORDINAL_CODES])


def one_hot(spark, d):
    rows = customer_table(spark, d).select(ID, *NOMINAL_COLUMNS)
    out = encode.one_hot(rows, encode.fit_levels(rows, NOMINAL_COLUMNS))
    return _melted(out, out.columns[1:])


def one_hot_drop_first(spark, d):
    columns = ["CustomerType", "FavoriteSeason", "Region", "Gender", "AccountStatus"]
    rows = customer_table(spark, d).select(ID, *columns)
    filled = impute.impute_mode(rows, impute.fit_modes(rows, columns))
    levels = encode.fit_levels(filled, columns, repair=False)
    out = encode.one_hot(filled, levels, repair=False, drop_first=True, keep_source=True)
    return _melted(out, out.columns[1 + len(columns):])


def one_hot_residual(spark, d):
    out, _ = encode.one_hot_residual(customer_table(spark, d).select(ID, "Country"))
    return _melted(out, out.columns[1:])


def wide_levels(spark, d):
    """Positions of the levels of two columns with about as many levels as rows."""
    rows = customer_table(spark, d).select(ID, *WIDE_COLUMNS)
    placed = levels.level_positions(rows, levels.fit_level_table(rows, WIDE_COLUMNS, repair=False))
    return placed.select(ID, *[F.col(f"{c}_position") for c in WIDE_COLUMNS])


def ip_class(spark, d):
    rows = encode.add_ip_class(customer_table(spark, d).select(ID, "LastLoginIP"))
    out = encode.one_hot(rows, encode.fit_levels(rows, ["IPClass"]), keep_source=True)
    return out.select(ID, "IPClass", "IPClass_Class_A", "IPClass_Class_B", "IPClass_Class_C")


def risk_description(spark, d):
    return _given(spark, d).select(
        ID, risk.risk_description("p", "service").alias("service"),
        risk.risk_description("p", "api").alias("api"))


def risk_recommendation(spark, d):
    return _given(spark, d).select(
        ID, risk.risk_recommendation("p", "service").alias("service"),
        risk.risk_recommendation("p", "api").alias("api"))


def validate_requests(spark, d):
    fields = [f.name for f in REQUEST_FIELDS if f.name != "ReturnRatio"]
    checked = validate.validate_requests(customer_table(spark, d).select(ID, *fields))
    return checked.select(
        ID, F.array_join("violations", ",").alias("violations"), "ReturnRatio",
        (F.size("violations") == 0).alias("valid"))


def predictions_agree(spark, d):
    given = _given(spark, d)
    main = F.when(F.col(ID) % 89 != 0, F.col("y_pred"))
    return given.select(ID, risk.predictions_agree(main, "v3").alias("predictions_agree"))


# --- imputation, scaling, splitting -----------------------------------------------------

def impute_median(spark, d):
    rows = clean.sentinel_to_null(customer_table(spark, d)).select(ID, *NUMERIC_COLUMNS)
    return impute.impute_median(rows, impute.fit_medians(rows, NUMERIC_COLUMNS))


def impute_mode(spark, d):
    rows = customer_table(spark, d)
    columns = string_fields(rows.schema)
    rows = rows.select(ID, *columns)
    return impute.impute_mode(rows, impute.fit_modes(rows, columns))


def standard_scale(spark, d):
    rows = customer_table(spark, d).select(ID, *NUMERIC_COLUMNS)
    filled = impute.impute_median(rows, impute.fit_medians(rows, NUMERIC_COLUMNS))
    return _rounded(scale.scale(filled, scale.fit_scaler(filled, NUMERIC_COLUMNS)))


def stratified_split(spark, d):
    return split.stratified_split(customer_table(spark, d)).select(ID, LABEL, "split")


def stratified_folds(spark, d):
    return split.stratified_folds(customer_table(spark, d)).select(ID, LABEL, "fold")


def sample_n(spark, d):
    return split.sample_n(customer_table(spark, d)).select(ID, LABEL)


def smote_counts(spark, d):
    vectors, _ = _explored(spark, d)
    rows = split.stratified_split(vectors).filter("split = 'train'")
    return smote.smote(rows).groupBy(LABEL).agg(
        F.count_if(~F.col("synthetic")).alias("before"), F.count(F.lit(1)).alias("after"))


def smote_rows(spark, d):
    vectors, _ = _explored(spark, d)
    made = smote.smote(split.stratified_split(vectors).filter("split = 'train'"))
    return made.select(ID, LABEL, "synthetic", vector_to_array("features").alias("features"))


def nearest_minority(spark, d):
    """The neighbour search on its own, on two integer coordinates, checked by SQL."""
    rows = customer_table(spark, d).filter(F.col(LABEL) == 1)
    points = rows.groupBy(
        F.array(F.col("Recency").cast("double"), F.col("UniqueProducts").cast("double")).alias("features")
    ).agg(F.min(ID).alias("id"), F.count(F.lit(1)).alias("copies"))
    found = neighbours.nearest_neighbours(stage(points, "points"), 5)
    return found.select(
        F.col("id").alias(ID),
        F.round(F.get("neighbours", F.lit(0))["distance"], 6).alias("nearest"),
        F.round(F.get("neighbours", F.lit(4))["distance"], 6).alias("fifth"))


# --- models and evaluation --------------------------------------------------------------

def pca_projection(spark, d):
    vectors, _ = _explored(spark, d)
    return pca.fit_pca(vectors, 2).project(vectors).select(ID, LABEL, "pc1", "pc2")


def pca_variance(spark, d):
    vectors, names = _explored(spark, d)
    ratios = pca.fit_pca(vectors, len(names)).ratios
    table = pca.variance_table(spark, ratios)
    return table.withColumn("components_for_95", F.lit(pca.components_for(ratios)))


def wide_pca_variance(spark, d):
    """Components of sparse vectors: some numbers and the levels of columns with very many."""
    rows = customer_table(spark, d)
    fitted = levels.fit_level_table(rows, ["Country", *WIDE_COLUMNS])
    vectors = levels.assemble_wide(rows, ["Recency", "Frequency", "UniqueProducts"], fitted, [ID])
    return pca.variance_table(spark, wide_pca.fit_wide_pca(vectors, 5).ratios)


def kmeans_sweep(spark, d):
    vectors, _ = _explored(spark, d)
    result = cluster.kmeans_sweep(vectors)
    return result.table.withColumn("best", F.col("k") == result.best_k)


def cluster_sizes(spark, d):
    vectors, _ = _explored(spark, d)
    return cluster.cluster_sizes(cluster.assign_clusters(vectors, 4))


def silhouette_scores(spark, d):
    """The silhouettes on their own, of three given assignments, checked by SQL."""
    features = F.array(*[F.col(c).cast("double") for c in ("Recency", "UniqueProducts", "Frequency")])
    rows = customer_table(spark, d).select(
        features.alias("features"), F.least(F.floor(F.col("Recency") / 150), F.lit(4)).cast("int").alias("by_recency"),
        (F.col("Frequency") > 5).cast("int").alias("by_frequency"), (F.col(ID) % 3).cast("int").alias("by_id"))
    return _rounded(silhouette.silhouettes(rows, ["by_recency", "by_frequency", "by_id"]))


def model_comparison(spark, d):
    """The four classifiers at their full sizes, in five folds."""
    ready = prepared(spark, d, 5)
    rows = ready.vectors("train")
    result = train.compare_models(rows, ready.vectors("test"), train.candidates(rows.count()))
    return result.table.withColumn("best", F.col("model") == F.lit(result.best))


def grid_search(spark, d):
    grid = {"maxIter": [3], "maxDepth": [2, 3], "stepSize": [0.1, 0.3], "subsamplingRate": [1.0]}
    return train.grid_search(prepared(spark, d).vectors("train"), grid, FOLDS).table


def full_grid_search(spark, d):
    """All 36 settings in five folds: 18 shared fits a fold."""
    return train.grid_search(prepared(spark, d, 5).vectors("train"), train.FULL_GRID, 5).table


def second_order_boosting(spark, d):
    """The second-order booster at its full size, scored on the test rows."""
    ready = prepared(spark, d)
    model = train.second_order_boosting().fit(ready.vectors("train"))
    return train.predict(model, ready.vectors("test")).select(ID, LABEL, "prediction", "probability")


def deep_forest(spark, d):
    """A hundred fully grown trees, scored on the test rows."""
    ready = prepared(spark, d)
    model = train.deep_forest().fit(ready.vectors("train"))
    return train.predict(model, ready.vectors("test")).select(ID, LABEL, "prediction", "probability")


def voting_classifier(spark, d):
    ready = prepared(spark, d)
    members = [
        train.deep_forest(SMALL), train.gradient_boosting(SMALL), train.second_order_boosting(SMALL, depth=4)]
    voting = train.fit_voting(ready.vectors("train"), members, FOLDS)
    return train.vote_with(voting.models, ready.vectors("test")).select(ID, LABEL, "voting_prediction")


def rf_smote(spark, d):
    vectors, _ = _explored(spark, d)
    rows = split.stratified_split(vectors)
    balanced = stage(smote.smote(rows.filter("split = 'train'")), "balanced")
    model = train.deep_forest().fit(balanced)
    scored = train.predict(model, rows.filter("split = 'test'"))
    return evaluate.classification_report(scored, LABEL, "prediction")


def scored_batch(spark, d):
    models = _classifier(spark, d)
    rows = prepared(spark, d).vectors("train")
    models.voters = [train.gradient_boosting(SMALL).fit(rows), train.random_forest(SMALL).fit(rows), models.classifier]
    scored = score_batch(customer_table(spark, d), models, details=True, texts="service")
    return scored.select(
        ID, "churn_prediction", "churn_probability", "churn_risk_level", "churn_risk_description",
        "churn_recommendation", "success", "error", "voting_prediction", "predictions_agree")


def score_batch_counts(spark, d):
    return report.score_counts(score_batch(customer_table(spark, d), _classifier(spark, d), variant="api"))


def feature_importance(spark, d):
    ready = prepared(spark, d)
    model = train.random_forest(SMALL).fit(ready.vectors("train"))
    return train.feature_importance(model, ready.features.feature_names, spark, 20)


def learning_curve(spark, d):
    ready = prepared(spark, d)
    rows = ready.vectors("train")
    return train.learning_curve(
        rows, ready.vectors("test"), train.logistic_regression(rows.count(), SMALL), (0.25, 0.5, 1.0))


def predict_monetary(spark, d):
    features = prepared(spark, d).features.feature_names
    inputs = [f for f in features if not f.startswith(("Monetary", "SpendingCategory", "AvgValue"))]
    rows = assemble(prepared(spark, d).table, inputs, keep=[ID, "MonetaryTotal", "split"])
    model = train.fit_regressor(rows.filter("split = 'train'"), "MonetaryTotal", SMALL)
    return model.transform(rows.filter("split = 'test'")).select(ID, "MonetaryTotal", "predicted_monetary")


# --- reports and stream -----------------------------------------------------------------

def _banded(spark, d):
    return _given(spark, d).select(
        ID, F.col("y_pred").alias("churn_prediction"), F.col("y_score").alias("churn_probability"),
        risk.risk_level("p").alias("churn_risk_level"))


def indexed_batch(spark, d):
    return report.with_index(_banded(spark, d)).select("index", ID, "churn_risk_level")


def risk_profiles(spark, d):
    scored = score_batch(profile_rows(spark), _classifier(spark, d))
    return scored.filter("success").select(
        "profile", "churn_prediction", "churn_probability", "churn_risk_level")


def _streamed(spark, d):
    source, target = new_path(spark, "arriving"), new_path(spark, "stream")
    rows = customer_table(spark, d)
    rows.write.option("maxRecordsPerFile", -(-rows.count() // 3)).parquet(source)
    query = score_stream(
        spark, source, RAW_SCHEMA, _classifier(spark, d), target, f"{target}/checkpoint",
        files_per_batch=2)
    query.awaitTermination()
    return read_results(spark, target, "scored"), read_results(spark, target, "rejected")


def stream_scoring(spark, d):
    scored, _ = _streamed(spark, d)
    return scored.select(ID, "churn_prediction", "churn_probability", "churn_risk_level", "success")


def stream_counts(spark, d):
    """Where each arriving customer landed: scored, failed alone, or rejected with its rules."""
    scored, refused = _streamed(spark, d)
    landed = scored.select(ID, F.when(F.col("success"), "scored").otherwise("failed").alias("landed"))
    return landed.unionByName(refused.select(ID, F.lit("rejected").alias("landed")))


def high_risk_report(spark, d):
    """Which customers are at risk, and how many per level."""
    scored = score_batch(customer_table(spark, d), _classifier(spark, d), impute=True)
    return report.risk_distribution(scored)


QUERIES: dict[str, Query] = {
    "customers": fixtures.customers,
    "scan_customers": scan_customers,
    "roundtrip_processed": roundtrip_processed,
    "train_test_read": train_test_read,
    "model_roundtrip": model_roundtrip,
    "export_predictions": export_predictions,
    "malformed_cells": malformed_cells,
    "profile_shape": lambda s, d: profile.profile_shape(customer_table(s, d)),
    "profile_dtypes": lambda s, d: profile.profile_dtypes(customer_table(s, d)),
    "missing_report": lambda s, d: profile.missing_report(customer_table(s, d)),
    "remaining_nulls": lambda s, d: profile.remaining_nulls(customer_table(s, d)),
    "describe_numeric": lambda s, d: _rounded(profile.describe_numeric(customer_table(s, d)), 4),
    "class_distribution": lambda s, d: profile.class_distribution(customer_table(s, d)),
    "class_distribution_by_split": class_distribution_by_split,
    "iqr_outliers": lambda s, d: _rounded(profile.iqr_outliers(customer_table(s, d))),
    "histogram": lambda s, d: _rounded(profile.histogram(customer_table(s, d))),
    "value_counts": lambda s, d: profile.value_counts(customer_table(s, d)),
    "correlation_matrix": lambda s, d: _rounded(correlation.correlation_matrix(customer_table(s, d))),
    "churn_correlation": lambda s, d: _rounded(correlation.churn_correlation(customer_table(s, d))),
    "multicollinear": lambda s, d: correlation.multicollinear(customer_table(s, d)),
    "duplicate_rows": duplicate_rows,
    "duplicate_rows_attributes": duplicate_rows_attributes,
    "box_stats": box_stats,
    "preview": lambda s, d: profile.preview(customer_table(s, d)),
    "drop_columns": lambda s, d: clean.drop_columns(
        customer_table(s, d), ["RegistrationDate", "NewsletterSubscribed", "LastLoginIP", "Absent"]),
    "engineer_features": lambda s, d: engineer_features(customer_table(s, d)).select(ID, *ENGINEERED_COLUMNS),
    "sentinel_to_null": sentinel_to_null,
    "ordinal_encode": ordinal_encode,
    "ordinal_encode_mapped": ordinal_encode_mapped,
    "one_hot": one_hot,
    "one_hot_drop_first": one_hot_drop_first,
    "one_hot_residual": one_hot_residual,
    "wide_levels": wide_levels,
    "ip_class": ip_class,
    "risk_level": lambda s, d: _given(s, d).select(ID, risk.risk_level("p").alias("level")),
    "risk_description": risk_description,
    "risk_recommendation": risk_recommendation,
    "segment_action": lambda s, d: risk.segment_action(customer_table(s, d)).select(ID, "segment", "action"),
    "gauge_band": lambda s, d: _given(s, d).select(ID, risk.gauge_band("p").alias("band")),
    "align_features": lambda s, d: align_features(customer_table(s, d), ALIGN_NAMES, keep=[ID]),
    "validate_requests": validate_requests,
    "predictions_agree": predictions_agree,
    "impute_median": impute_median,
    "impute_mode": impute_mode,
    "standard_scale": standard_scale,
    "stratified_split": stratified_split,
    "stratified_folds": stratified_folds,
    "sample_n": sample_n,
    "smote_counts": smote_counts,
    "smote": smote_rows,
    "nearest_minority": nearest_minority,
    "pca_projection": pca_projection,
    "pca_variance": pca_variance,
    "wide_pca_variance": wide_pca_variance,
    "kmeans_sweep": kmeans_sweep,
    "cluster_sizes": cluster_sizes,
    "silhouettes": silhouette_scores,
    "model_comparison": model_comparison,
    "grid_search": grid_search,
    "full_grid_search": full_grid_search,
    "second_order_boosting": second_order_boosting,
    "deep_forest": deep_forest,
    "vote": lambda s, d: evaluate.hard_vote(_given(s, d), ["v1", "v2", "v3"]).select(ID, "vote"),
    "voting_classifier": voting_classifier,
    "rf_smote": rf_smote,
    "score_batch": scored_batch,
    "score_batch_counts": score_batch_counts,
    "confusion_matrix": lambda s, d: evaluate.confusion_matrix(_given(s, d)),
    "classification_report": lambda s, d: _rounded(evaluate.classification_report(_given(s, d))),
    "roc_curve": lambda s, d: _rounded(evaluate.roc_curve(_given(s, d), score="p")),
    "roc_auc": lambda s, d: _rounded(evaluate.roc_auc(_given(s, d), score="p")),
    "pr_curve": lambda s, d: _rounded(evaluate.pr_curve(_given(s, d), score="p")),
    "average_precision": lambda s, d: _rounded(evaluate.average_precision(_given(s, d), score="p")),
    "feature_importance": feature_importance,
    "learning_curve": learning_curve,
    "predict_monetary": predict_monetary,
    "batch_summary": lambda s, d: _rounded(report.batch_summary(_banded(s, d))),
    "risk_distribution": lambda s, d: report.risk_distribution(_banded(s, d)),
    "indexed_batch": indexed_batch,
    "risk_profiles": risk_profiles,
    "stream_scoring": stream_scoring,
    "stream_counts": stream_counts,
    "high_risk_report": high_risk_report,
}
