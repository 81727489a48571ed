"""Splits, folds, samples, curves and balancing."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ebbtide.operators import evaluate, neighbours, split
from ebbtide.operators.neighbours import nearest_neighbours, pivot_tree
from ebbtide.operators.report import with_index
from ebbtide.operators.smote import smote


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(1003).selectExpr("id AS CustomerID", "cast(id % 7 = 0 AS int) AS Churn").cache()


def _keys(ids, seed=42):
    return sorted(hashlib.md5(f"{i}:{seed}".encode()).hexdigest() for i in ids)


def test_split_is_exact_per_class(labelled):
    rows = split.stratified_split(labelled).collect()
    for c in (0, 1):
        ids = [r.CustomerID for r in rows if r.Churn == c]
        test = {r.CustomerID for r in rows if r.Churn == c and r.split == "test"}
        assert len(test) == int(0.2 * len(ids) + 0.5)
        assert _keys(test) == _keys(ids)[:len(test)]


def test_cuts_with_long_prefixes_are_the_same(labelled):
    key = split.shuffle_key("CustomerID", 42)

    def wanted(n):
        return [0, 1, n // 3, n]

    assert split.rank_cuts(labelled, key, wanted, "Churn") == split.rank_cuts(
        labelled, key, wanted, "Churn", gather_rows=1)


def test_split_does_not_depend_on_row_order_or_partitions(labelled):
    a = split.stratified_split(labelled).filter("split = 'test'")
    b = split.stratified_split(labelled.orderBy(F.rand(3)).repartition(7)).filter("split = 'test'")
    assert {r.CustomerID for r in a.collect()} == {r.CustomerID for r in b.collect()}


def test_folds_are_balanced(labelled):
    rows = split.stratified_folds(labelled, 5).groupBy("Churn", "fold").count().collect()
    for c in (0, 1):
        sizes = [r["count"] for r in rows if r.Churn == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_more_folds_than_rows(spark):
    few = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "CustomerID long, Churn int")
    rows = split.stratified_folds(few, 5).collect()
    assert sorted(r.fold for r in rows if r.Churn == 0) == [0, 1]


def test_sample_size(labelled):
    assert split.sample_n(labelled, 300).count() == 300
    assert split.sample_n(labelled, 5000).count() == 1003
    assert split.sample_n(labelled.limit(0), 10).count() == 0


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, y_score double")


def pair_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("cell", [500_000, 3])
def test_auc_counts_pairs(spark, cell):
    rng = np.random.default_rng(5)
    pairs = [(int(rng.random() < 0.4), float(rng.integers(0, 12)) / 10) for _ in range(200)]
    pairs += [(1, 0.5)] * 80  # one score holds a large share of the rows
    frame = scores(spark, pairs)
    assert evaluate.roc_auc(frame, rows_per_cell=cell).first()["auc"] == pytest.approx(pair_auc(pairs))


def test_cells_give_the_same_curves(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(rng.random() < 0.3), round(float(rng.random()), 2)) for _ in range(400)]
    frame = scores(spark, pairs)
    for curve in (evaluate.roc_curve, evaluate.pr_curve):
        a, b = curve(frame), curve(frame, rows_per_cell=7)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    ap = evaluate.average_precision(frame)
    assert ap.first()[0] == pytest.approx(evaluate.average_precision(frame, rows_per_cell=7).first()[0])


def test_index_is_the_same_in_one_cell_and_in_many(labelled):
    one = {tuple(r)[:2] for r in with_index(labelled).collect()}
    assert one == {tuple(r)[:2] for r in with_index(labelled, rows_per_cell=50).collect()}
    assert one == {(i, i) for i in range(1003)}


def test_curve_ends_and_dropped_points(spark):
    frame = scores(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)])
    points = [tuple(r) for r in evaluate.roc_curve(frame).orderBy(F.desc("threshold")).collect()]
    assert points == [(float("inf"), 0.0, 0.0), (0.9, 0.0, pytest.approx(1 / 3)), (0.7, 0.0, 1.0), (0.5, 1.0, 1.0)]
    assert evaluate.roc_curve(frame, drop_intermediate=False).count() == 6


def test_single_class_and_missing_scores(spark):
    assert evaluate.roc_auc(scores(spark, [(1, 0.2), (1, 0.4)])).first()["auc"] is None
    frame = scores(spark, [(1, 0.9), (0, 0.1), (1, None), (0, float("nan"))])
    assert evaluate.roc_auc(frame).first()["auc"] == 1.0
    assert evaluate.roc_auc(frame.limit(0)).first()["auc"] is None


def test_empty_denominators(spark):
    frame = spark.createDataFrame([(1, 0), (0, 0)], "y_true int, y_pred int")
    assert tuple(evaluate.binary_scores(frame).first()) == (0.0, 0.0, 0.0)
    report = {r["class"]: r for r in evaluate.classification_report(frame).collect()}
    assert report["0"]["precision"] == 0.5 and report["accuracy"]["f1"] == 0.5
    cells = evaluate.confusion_matrix(frame).collect()
    assert sorted((r.y_true, r.y_pred, r.n) for r in cells) == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0)]


def test_vote_tie_goes_to_the_lower_class(spark):
    frame = spark.createDataFrame([(1, 0), (1, 1), (0, 0)], "a int, b int")
    assert [r.vote for r in evaluate.hard_vote(frame, ["a", "b"]).collect()] == [0, 1, 0]


def _points(spark, x):
    rows = [(i, 1, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, copies long, features array<double>")


@pytest.mark.parametrize("shape, block", [("blobs", 16), ("line", 8), ("uniform", 32)])
def test_neighbours_equal_brute_force(spark, shape, block):
    rng = np.random.default_rng(8)
    x = {
        "blobs": np.concatenate([rng.normal(c * 20, 1, (40, 4)) for c in range(5)]),
        "line": np.arange(120.0)[:, None] * [1.0, 2.0],
        "uniform": rng.random((150, 6)),
    }[shape]
    found = {r.id: [n.distance for n in r.neighbours] for r in nearest_neighbours(_points(spark, x), 5, block).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    assert len(found) == len(x)
    for i in range(len(x)):
        np.testing.assert_allclose(found[i], np.sort(far[i])[:5], atol=1e-9)


@pytest.mark.parametrize("shape", ["outliers", "clusters", "grid", "offset"])
def test_deep_pivot_trees_equal_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    x = {
        "outliers": np.concatenate([rng.normal(0, 1, (250, 3)), 1000.0 * rng.normal(size=(12, 3))]),
        "clusters": np.concatenate([rng.normal(c * 9, 0.5, (60, 2)) for c in range(6)]),
        "grid": np.array([[float(a), float(b)] for a in range(18) for b in range(18)]),
        "offset": rng.random((200, 3)) + 1e7,
    }[shape]
    points = _points(spark, x)
    tree = pivot_tree(points, 6, 5, 3)
    assert tree.levels > 2
    sizes = tree.points.groupBy("node").count().toPandas()["count"]
    assert sizes.sum() == len(x) and sizes.max() <= 24
    found = {r.id: r.neighbours for r in nearest_neighbours(points, 4, 6, 5, 3).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), far[i]))[:4]
        np.testing.assert_allclose([n.distance for n in found[i]], far[i][order], rtol=1e-9, atol=1e-9)
        assert len({n.id for n in found[i]}) == 4
        if shape == "grid":  # ties go to the smaller id
            assert [n.id for n in found[i]] == order.tolist()


def test_a_leaf_that_cannot_be_split_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_LEVELS", 1)
    x = np.random.default_rng(2).random((300, 2))
    found = {r.id: [n.distance for n in r.neighbours] for r in nearest_neighbours(_points(spark, x), 3, 20, 2, 2).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    for i in range(len(x)):
        np.testing.assert_allclose(found[i], np.sort(far[i])[:3], atol=1e-9)


@pytest.mark.parametrize("dense", [8, 0])
def test_points_that_reach_all_leaves_are_met_without_written_visits(spark, monkeypatch, dense):
    monkeypatch.setattr(neighbours, "DENSE", dense)
    monkeypatch.setattr(neighbours, "STRIPE_BYTES", 4_096)
    monkeypatch.setattr(neighbours, "HELD_BLOCKS", 2)
    written, stage = [], neighbours.stage
    monkeypatch.setattr(neighbours, "stage", lambda df, label: written.append(label) or stage(df, label))
    x = np.random.default_rng(6).random((240, 12)).round(1)
    found = {r.id: r.neighbours for r in nearest_neighbours(_points(spark, x), 5, 16).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), far[i].round(9)))[:5]
        np.testing.assert_allclose([n.distance for n in found[i]], far[i][order], atol=1e-9)
    assert ("visits" in written) == (dense == 0)


def test_a_part_of_the_leaves_tells_whether_blocks_are_met(spark, monkeypatch):
    """Pairs of all leaves are not written where most of them remain, and blocks hold several leaves."""
    monkeypatch.setattr(neighbours, "ASKED_LEAVES", 4)
    asked, pairs = [], neighbours.leaf_pairs
    monkeypatch.setattr(neighbours, "leaf_pairs", lambda tree, reaches, k: asked.append(reaches.count()) or pairs(tree, reaches, k))
    x = np.random.default_rng(7).random((240, 10)).round(1)
    found = {r.id: [n.distance for n in r.neighbours] for r in nearest_neighbours(_points(spark, x), 5, 16).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    np.testing.assert_allclose([found[i] for i in range(len(x))], np.sort(far, axis=1)[:, :5], atol=1e-9)
    assert len(asked) == 1 and asked[0] < 12


def test_few_points_have_few_neighbours(spark):
    assert nearest_neighbours(_points(spark, np.zeros((1, 2))), 3).count() == 0
    assert nearest_neighbours(_points(spark, np.ones((1, 2))).limit(0), 3).count() == 0
    assert nearest_neighbours(_points(spark, np.arange(3.0)[:, None]), 3).selectExpr("size(neighbours) AS n").distinct().first().n == 2


def test_visits_grow_below_quadratic_on_clusters(spark):
    made = []
    for clusters in (8, 32):
        rng = np.random.default_rng(3)
        x = np.concatenate([rng.normal(rng.random(3) * 1000, 1, (100, 3)) for _ in range(clusters)])
        tree = pivot_tree(_points(spark, x), 50, 16, 8)
        reach = tree.points.withColumn("part", F.lit(0).cast("long")).withColumn("reach", F.lit(1.0))
        ends = reach.groupBy(F.col("node").alias("leaf")).agg(F.max("reach").alias("reach"))
        made.append(neighbours.leaf_visits(reach, neighbours.leaf_pairs(tree, ends, 5)).count())
    assert made[1] < 8 * made[0]  # four times the points; pairs of all leaves would be sixteen times


def _classes(spark, minority, majority_rows):
    rows = [(i, 1, [float(v) for v in r]) for i, r in enumerate(minority)]
    rows += [(1000 + i, 0, [0.0] * len(minority[0])) for i in range(majority_rows)]
    frame = spark.createDataFrame(rows, "CustomerID long, Churn int, values array<double>")
    return frame.select("CustomerID", "Churn", array_to_vector("values").alias("features"))


def test_smote_balances_on_segments_between_neighbours(spark):
    rng = np.random.default_rng(9)
    minority = rng.normal(size=(6, 3))
    out = smote(_classes(spark, minority, 40))
    counts = {(r.Churn, r.synthetic): r["count"] for r in out.groupBy("Churn", "synthetic").count().collect()}
    assert counts == {(0, False): 40, (1, False): 6, (1, True): 34}
    for row in out.filter("synthetic").collect():
        p = row.features.toArray()
        gaps = [
            np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)
            for a, b in itertools.combinations(minority, 2)]
        assert min(gaps) < 1e-9
    again = smote(_classes(spark, minority, 40)).filter("synthetic")
    assert sorted(str(r.features) for r in again.collect()) == sorted(
        str(r.features) for r in out.filter("synthetic").collect())


def test_smote_with_a_large_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr("ebbtide.operators.smote.ROWS_PER_CHUNK", 7)
    minority = [[1.0, 1.0]] * 30 + [[float(i), 0.0] for i in range(10, 20)]
    out = smote(_classes(spark, minority, 200))
    made = [r.features.toArray().tolist() for r in out.filter("synthetic").collect()]
    assert len(made) == 160
    # A copy's five neighbours are other copies, so its synthetic rows are copies too.
    assert sum(m == [1.0, 1.0] for m in made) == 120


def test_smote_refuses_and_passes_through(spark):
    with pytest.raises(ValueError, match="too few"):
        smote(_classes(spark, [[float(i)] for i in range(5)], 20))
    balanced = smote(_classes(spark, [[float(i)] for i in range(8)], 8))
    assert balanced.count() == 16 and balanced.filter("synthetic").count() == 0
