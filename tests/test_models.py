"""Training, scoring, persistence and the stream, on the given tables."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ebbtide.operators import cluster, pca, train
from ebbtide.operators.assemble import assemble
from ebbtide.operators.profiles import risk_profiles
from ebbtide.operators.score import score_batch
from ebbtide.plans import catalog, workflow
from ebbtide.plans.features import FeatureBuilder
from ebbtide.schema import ID, LABEL, RAW_SCHEMA
from ebbtide.sources import models as store
from ebbtide.sources import tables
from ebbtide.sources.staging import new_path, stage
from ebbtide.streaming.scoring import score_requests, score_stream

TINY = train.Settings(trees=5, forest_depth=3, iterations=3, max_iter=30)


@pytest.fixture(scope="module")
def models(ready):
    rows = ready.vectors("train")
    classifier = train.logistic_regression(rows.count(), TINY).fit(rows)
    voters = [train.random_forest(TINY).fit(rows), train.gradient_boosting(TINY).fit(rows), classifier]
    return store.ModelSet(ready.features, classifier, voters, cluster.fit_kmeans(rows, 3, 1))


def test_classifier_beats_chance(models, ready):
    assert train.auc_score(models.classifier, ready.vectors("test")) > 0.7


def test_folds_cover_the_training_rows_only(ready):
    counts = ready.table.groupBy("split", "fold").count().collect()
    train_sizes = [r["count"] for r in counts if r.split == "train"]
    assert len(train_sizes) == catalog.FOLDS and max(train_sizes) - min(train_sizes) <= 2


def test_comparison_picks_the_first_best(ready):
    rows = ready.vectors("train")
    models = {"a": train.logistic_regression(rows.count(), TINY), "b": train.logistic_regression(rows.count(), TINY)}
    for by in ("cv_f1", "test_f1"):
        result = train.compare_models(rows, ready.vectors("test"), models, 2, by)
        assert result.best == "a" and result.table.count() == 2


def test_no_best_model_when_all_scores_are_zero(ready):
    rows = ready.vectors("train")
    flat = train.logistic_regression(1, TINY).setRegParam(1e6)
    assert train.compare_models(rows, ready.vectors("test"), {"flat": flat}, 2).best is None


def test_grid_and_vote(ready):
    rows = ready.vectors("train")
    result = train.grid_search(rows, {"maxIter": [1, 2], "maxDepth": [1]}, 2)
    best = max(result.table.collect(), key=lambda r: r.cv_f1_mean)
    assert result.best_score == best.cv_f1_mean and result.table.count() == 2
    voting = train.fit_voting(rows, [train.random_forest(TINY)] * 3, 2)
    voted = train.vote_with(voting.models, rows)
    alone = train.predict(voting.models[0], rows)
    assert voted.join(alone, ID).filter("voting_prediction <> prediction").count() == 0


def test_importance_of_trees_and_linear_models(spark, models, ready):
    names = ready.features.feature_names
    for model in (models.voters[0], models.classifier):
        top = train.feature_importance(model, names, spark, 10).collect()
        assert len(top) == 10 and top[0].importance >= top[-1].importance >= 0
    assert train.feature_importance(models.kmeans, names, spark).count() == 0


def test_learning_curve_sizes_grow(ready):
    rows = ready.vectors("train")
    curve = train.learning_curve(rows, ready.vectors("test"), train.logistic_regression(100, TINY), (0.5, 1.0))
    sizes = [r.n_train for r in curve.orderBy("fraction").collect()]
    assert sizes[0] < sizes[1] == rows.count()


def test_failed_rows_fail_alone(customers, models):
    scored = score_batch(customers, models, details=True, texts="api").cache()
    assert scored.count() == customers.count()
    failed = scored.filter("NOT success")
    assert 0 < failed.count() < scored.count()
    wrong = failed.filter(
        "churn_prediction <> -1 OR churn_probability <> -1 OR churn_risk_level <> 'Unknown' "
        "OR error IS NULL OR voting_prediction <> -1 OR predictions_agree OR cluster IS NOT NULL")
    assert wrong.count() == 0
    good = scored.filter("success")
    assert good.filter("Age IS NULL OR churn_probability NOT BETWEEN 0 AND 1 OR error IS NOT NULL").count() == 0
    assert good.filter("predictions_agree <> (churn_prediction = voting_prediction)").count() == 0


def test_api_variant_rounds_after_banding(customers, models):
    exact = score_batch(customers, models).select(ID, F.col("churn_probability").alias("p"), "churn_risk_level")
    api = score_batch(customers, models, variant="api").withColumnRenamed("churn_risk_level", "level")
    both = exact.join(api, ID)
    assert both.filter("success AND (churn_probability <> round(p, 4) OR level <> churn_risk_level)").count() == 0
    assert both.filter("NOT success AND churn_prediction IS NOT NULL").count() == 0


def test_imputing_scores_every_row(customers, models):
    assert score_batch(customers, models, impute=True).filter("NOT success").count() == 0


def test_row_order_does_not_matter(customers, models):
    a = score_batch(customers, models).select(ID, "churn_probability")
    b = score_batch(customers.repartition(5).orderBy(F.desc(ID)), models).select(ID, "churn_probability")
    assert a.exceptAll(b).count() == 0


def test_partial_input_and_fill_modes(spark, models):
    request = spark.createDataFrame([(50, 5, 1000.0)], "Recency int, Frequency int, MonetaryTotal double")
    zero = score_batch(request, models).first()
    median = score_batch(request, models, fill="median").first()
    assert zero.success and median.success and zero.churn_probability != median.churn_probability


def test_risk_profiles_score(spark, models):
    scored = score_batch(risk_profiles(spark), models)
    assert scored.count() == 4 and scored.filter("success").count() == 4


def test_saved_models_give_equal_scores(spark, customers, models):
    path = new_path(spark, "set")
    store.save_models(models, path, spark)
    again = store.load_models(path, spark)
    assert again.feature_names == models.feature_names and len(again.voters) == 3 and again.regressor is None
    a = score_batch(customers, models, details=True)
    b = score_batch(customers, again, details=True)
    assert a.exceptAll(b).count() == 0


def test_missing_parts(spark, models):
    with pytest.raises(FileNotFoundError):
        store.load_models(new_path(spark, "nothing"), spark)
    path = new_path(spark, "partial")
    store.save_models(store.ModelSet(models.features, models.classifier), path, spark)
    manifest = ('{"parts": ["features", "classifier", "kmeans"], "feature_names": ["a"]}',)
    spark.createDataFrame([manifest], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    assert store.load_models(path, spark).kmeans is None
    lacking = ('{"parts": ["features", "kmeans"], "feature_names": ["a"]}',)
    spark.createDataFrame([lacking], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(ValueError, match="classifier"):
        store.load_models(path, spark)


def test_stream_equals_batch_and_replays_once(spark, customers, models):
    source, target = new_path(spark, "in"), new_path(spark, "out")
    customers.repartition(4).write.parquet(source)
    run = lambda: score_stream(
        spark, source, RAW_SCHEMA, models, target, f"{target}/checkpoint", files_per_batch=2).awaitTermination()
    run()
    run()  # nothing new: nothing is scored twice
    scored, refused = score_requests(customers, models)
    columns = [ID, "churn_probability", "churn_risk_level", "churn_recommendation", "success"]
    streamed = spark.read.parquet(f"{target}/scored")
    assert streamed.count() == scored.count()
    assert streamed.select(columns).exceptAll(scored.select(columns)).count() == 0
    assert spark.read.parquet(f"{target}/rejected").count() == refused.count() > 0


def test_csv_in_predictions_out(spark, customers, models):
    source, output = new_path(spark, "upload"), new_path(spark, "predictions")
    customers.write.option("header", True).csv(source)
    path = workflow.score_file(spark, source, models, output, schema=RAW_SCHEMA)
    assert path.startswith(f"{output}/predictions_2")
    assert spark.read.option("header", True).csv(path).count() == customers.count()
    narrow = new_path(spark, "narrow")
    customers.select("Recency").write.option("header", True).csv(narrow)
    with pytest.raises(ValueError, match="Frequency"):
        workflow.score_file(spark, narrow, models, output)


def test_unparsable_and_nan_values_become_null(spark):
    path = new_path(spark, "dirty")
    spark.createDataFrame([("1", "abc"), ("2", "NaN"), ("3", "4.5")], "CustomerID string, x string").write.option(
        "header", True).csv(path)
    rows = tables.read_customers(spark, path, schema="CustomerID long, x double")
    assert {r.CustomerID: r.x for r in rows.collect()} == {1: None, 2: None, 3: 4.5}


def test_csv_columns_match_by_name_and_whole_numbers_may_carry_a_point(spark):
    path = new_path(spark, "shuffled")
    rows = [("x", "35.0", "1", "9007199254740993"), ("y", "", "0", "2"), ("z", "1.5", "1.0", "oops")]
    spark.createDataFrame(rows, "Note string, Age string, Churn string, CustomerID string").write.option(
        "header", True).csv(path)
    out = tables.read_customers(spark, path)
    assert dict(out.dtypes) == {"Note": "string", "Age": "bigint", "Churn": "int", "CustomerID": "bigint"}
    assert {r.Note: tuple(r)[1:] for r in out.collect()} == {
        "x": (35, 1, 9007199254740993), "y": (None, 0, 2), "z": (None, 1, None)}


def test_level_names_with_dots_and_quotes(spark):
    rows = spark.createDataFrame(
        [(i, float(i % 5), ["St. Lucia", "Côte d'Ivoire", "a`b"][i % 3], int(i % 2)) for i in range(40)],
        "CustomerID long, Recency double, Country string, Churn int")
    features = FeatureBuilder().fit(rows)
    assert "Country_St. Lucia" in features.feature_names
    vectors = assemble(features.transform(rows), features.feature_names, keep=[ID, LABEL])
    model = train.logistic_regression(40, TINY).fit(vectors)
    assert score_batch(rows, store.ModelSet(features, model)).filter("success").count() == 40


def test_feature_options(customers):
    part = FeatureBuilder(scaling="numeric", exclude=["ChurnRiskCategory", "Country"]).fit(customers)
    names = part.feature_names
    assert "ChurnRiskCategory" not in names and not any(n.startswith("Country_") for n in names)
    state = part.fitted
    assert "Recency" in state["scaler"] and "Gender_F" not in state["scaler"]
    assert part.transform(customers).columns[:2] == [ID, LABEL]


def test_fit_on_all_rows_reproduces_the_leak(customers, ready):
    everything = workflow.prepare(customers, fit_on="all")
    assert everything.features.fitted["scaler"] != ready.features.fitted["scaler"]


def test_components(ready, spark):
    rows = ready.vectors("train")
    parts = pca.fit_pca(rows, 3)
    projected = parts.project(rows)
    means = projected.agg(F.avg("pc1"), F.avg("pc2")).first()
    assert all(abs(m) < 1e-8 for m in means)
    assert parts.ratios == sorted(parts.ratios, reverse=True) and sum(parts.ratios) <= 1 + 1e-9
    assert pca.fit_pca(rows, 1).project(rows).filter("pc2 <> 0").count() == 0
    assert pca.components_for([0.6, 0.3, 0.1]) == 3 and pca.components_for([0.96, 0.04]) == 1
    assert [round(r.cumulative, 6) for r in pca.variance_table(spark, [0.6, 0.3, 0.1]).collect()] == [0.6, 0.9, 1.0]


def test_clusters(ready):
    rows = ready.vectors("train")
    sweep = cluster.kmeans_sweep(rows, range(2, 4), starts=1, max_iter=5)
    best = max(sweep.table.collect(), key=lambda r: r.silhouette)
    assert sweep.best_k == best.k
    sizes = cluster.cluster_sizes(cluster.assign_clusters(rows, 3, starts=1))
    assert sizes.agg(F.sum("n")).first()[0] == rows.count()


def test_prepare_and_train_from_a_file(spark, customers):
    source, output = new_path(spark, "raw"), new_path(spark, "job")
    customers.write.option("header", True).csv(source)
    trained = workflow.prepare_and_train(spark, source, output, settings=TINY, folds=2)
    assert trained.comparison.table.count() == 4
    assert store.load_models(f"{output}/models", spark).feature_names
    part = tables.read_split(spark, f"{output}/train_test", "test")
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()


def test_flagship(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark)
    assert rows.columns == ["churn_risk_level", "n"] and rows.agg(F.sum("n")).first()[0] == 150


def test_stream_fails_loudly_on_a_missing_model_feature(spark, customers):
    source, target = new_path(spark, "in"), new_path(spark, "out")
    customers.limit(5).write.parquet(source)
    query = score_stream(spark, source, RAW_SCHEMA, None, target, f"{target}/checkpoint")
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()


def test_stage_keeps_schema(spark):
    frame = spark.range(3).selectExpr("id", "array(cast(id AS double)) AS v")
    assert stage(frame, "x").schema.simpleString() == frame.schema.simpleString()


def test_model_comparison_runs_at_full_size(spark, monkeypatch):
    """A hundred trees and rounds and a thousand steps in five folds, not the sizes of a quick look."""
    from ebbtide.plans import catalog

    frame = spark.createDataFrame([(0,)], "x int").withColumn("fold", F.lit(0))
    seen = {}

    class Ready:
        def vectors(self, part):
            return frame

    def compared(rows, test, estimators, k=5, **kwargs):
        seen.update(estimators, k=k)
        return train.Comparison(spark.createDataFrame([("a",)], "model string"), {}, None)

    monkeypatch.setattr(catalog, "prepared", lambda s, d, folds=catalog.FOLDS: seen.update(folds=folds) or Ready())
    monkeypatch.setattr(train, "compare_models", compared)
    catalog.model_comparison(spark, "nowhere")
    assert seen["k"] == seen["folds"] == 5
    assert seen["Logistic Regression"].getMaxIter() == 1000 and seen["Random Forest"].getOrDefault("numTrees") == 100
    assert seen["Gradient Boosting"].getMaxIter() == 100 and seen["XGBoost"].getOrDefault("maxIter") == 100
