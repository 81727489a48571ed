"""K-means of many runs against a plain one, and silhouettes against all pairs."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ebbtide.operators import cluster, kmeans, silhouette
from ebbtide.operators.kmeans import Centres, best_runs, fit_runs, greedy_seeds
from ebbtide.operators.silhouette import silhouettes
from pyspark.ml.functions import vector_to_array


def blobs(n=240, seed=1, spread=0.6):
    draw = random.Random(seed)
    middles = [(0, 0), (6, 0), (0, 7), (9, 9)]
    return np.array([[a + draw.gauss(0, spread), b + draw.gauss(0, spread)] for a, b in (middles[i % 4] for i in range(n))])


@pytest.fixture(scope="module")
def points():
    return blobs()


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(points.tolist())], ["id", "features"]).repartition(5)


def plain_silhouette(x, labels):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1 or len(set(labels)) == 1:
            out.append(0.0)
            continue
        a = far[i][own].sum() / (own.sum() - 1)
        b = min(far[i][labels == d].mean() for d in set(labels) if d != c)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def lloyd(x, centres, rounds=300):
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if ((new - centres) ** 2).sum() <= 1e-4 * x.var(0).mean():
            break
        centres = new
    return ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_every_run_is_that_of_its_seeds(frame, points):
    runs = fit_runs(frame, [2, 3, 5], starts=3)
    assert [(r.k, r.start) for r in runs] == [(k, s) for k in (2, 3, 5) for s in range(3)]
    values = vector_to_array("features")
    seeds = greedy_seeds(frame.select(values.alias("x"), F.xxhash64(values).alias("key")), 2, 5, range(3), 2 + int(np.log(5)), 42)
    for run in runs:
        assert run.converged and run.cost == pytest.approx(lloyd(points, seeds[run.start][:run.k]), rel=1e-9)
        assert run.cost == pytest.approx(((points[:, None] - run.centres[None]) ** 2).sum(2).min(1).sum(), rel=1e-9)


def test_seeds_are_distinct_rows_whatever_the_partitions(frame, points):
    values = vector_to_array("features")
    found = []
    for parts in (1, 6):
        rows = frame.repartition(parts).select(values.alias("x"), F.xxhash64(values).alias("key"))
        found.append(greedy_seeds(rows, 2, 6, range(2), 3, 7))
    known = {tuple(p) for p in points.tolist()}
    for s in range(2):
        assert np.array_equal(found[0][s], found[1][s]) and {tuple(p) for p in found[0][s].tolist()} <= known
        assert len({tuple(p) for p in found[0][s].tolist()}) == 6
    assert not np.array_equal(found[0][0], found[0][1])


def test_cost_is_no_worse_than_that_of_separate_fits(frame):
    best = best_runs(fit_runs(frame, range(2, 7), starts=10))
    for k, run in best.items():
        apart = min(KMeans(k=k, seed=s, maxIter=300, featuresCol="features").fit(frame).summary.trainingCost for s in range(3))
        assert run.cost <= apart * 1.01
    assert best[4].cost < best[3].cost / 3


def test_partial_sums_are_added_in_tasks_where_they_are_many(frame, monkeypatch):
    few = fit_runs(frame, [3], starts=2)
    monkeypatch.setattr(kmeans, "PARTS", 2)
    for a, b in zip(few, fit_runs(frame, [3], starts=2)):
        assert np.allclose(a.centres, b.centres) and a.iterations == b.iterations


def test_fewer_distinct_rows_than_clusters(spark):
    same = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 5 + [(Vectors.dense([4.0, 6.0]),)], ["features"])
    run = best_runs(fit_runs(same, [4], starts=2))[4]
    assert run.cost == 0 and {tuple(c) for c in run.centres} == {(1.0, 2.0), (4.0, 6.0)}
    assert fit_runs(same.limit(0), [2]) == []


def test_model_is_saved(spark, frame, tmp_path):
    model = cluster.fit_kmeans(frame, 4, 2)
    PipelineModel([model]).write().save(str(tmp_path / "k"))
    again = PipelineModel.load(str(tmp_path / "k")).stages[0]
    assert isinstance(again, Centres) and again.trainingCost == model.trainingCost
    assert model.transform(frame).exceptAll(again.transform(frame)).count() == 0
    sizes = [r.n for r in cluster.cluster_sizes(model.transform(frame)).collect()]
    assert sorted(sizes) == [60, 60, 60, 60]


@pytest.mark.parametrize("block_rows", [16_384, 20, 1])
def test_silhouettes_of_all_pairs(spark, block_rows):
    x = np.vstack([blobs(60, 2, 1.5), [[0.5, 0.5]] * 7, [[50, 50]]])
    draw = random.Random(4)
    labels = {"near": (x[:, 0] + x[:, 1] > 7).astype(int), "any": np.array([draw.randint(0, 4) for _ in x]),
              "one": np.zeros(len(x), int), "alone": np.array([0] * (len(x) - 1) + [9]), "copies": np.array([i % 2 for i in range(len(x))])}
    rows = [(Vectors.dense(p), *[int(v[i]) for v in labels.values()]) for i, p in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, ["features", *labels]).repartition(3)
    for names in (list(labels), ["near"], ["copies"]):
        got = {r.assignment: r for r in silhouettes(df, names, block_rows=block_rows).collect()}
        assert set(got) == set(names)
        for c in names:
            assert got[c].silhouette == pytest.approx(plain_silhouette(x, labels[c]), abs=1e-9) and got[c].n == len(x)


def test_silhouettes_write_no_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(silhouette, "STRIPE_BYTES", 400)
    monkeypatch.setattr(silhouette, "HELD_BLOCKS", 2)
    x = blobs(120, 3, 1.5)
    df = spark.createDataFrame([(Vectors.dense(p), i % 4, i % 3) for i, p in enumerate(x.tolist())], ["features", "c", "d"])
    got = silhouettes(df, ["c", "d"], block_rows=10)
    text = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    below = text[text.index("CartesianProduct"):]
    assert "other_x" not in text[:text.index("CartesianProduct")].split("MapInArrow measure")[0] and "Join" not in below
    for r in got.collect():
        labels = np.arange(120) % (4 if r.assignment == "c" else 3)
        assert r.silhouette == pytest.approx(plain_silhouette(x, labels), abs=1e-9)


def test_silhouettes_skip_far_clusters_and_missing_labels(spark):
    x = blobs(200, 5, 0.2)
    df = spark.createDataFrame([(Vectors.dense(p), i % 4 if i % 10 else None) for i, p in enumerate(x.tolist())], ["features", "c"])
    kept = np.array([i for i in range(200) if i % 10])
    got = silhouettes(df, ["c"]).first()
    assert got.n == 180 and got.silhouette == pytest.approx(plain_silhouette(x[kept], kept % 4), abs=1e-9)
    assert silhouettes(df.limit(0), ["c"]).count() == 0


def test_silhouettes_of_points_with_gaps(spark):
    """A missing coordinate: no distances, silhouette 0, and the sizes of the clusters count the point."""
    x = np.round(blobs(90, 3, 1.5), 1).tolist()
    for i in (4, 5, 17):
        x[i][1] = None
    rows = [(p, i % 3, 7 if i in (4, 17) else i % 2, 5) for i, p in enumerate(x)]
    known = np.array(x, float)
    far = np.sqrt(((known[:, None] - known[None]) ** 2).sum(2))

    def plain(labels):
        out = []
        for i, own in enumerate(labels):
            total = {c: far[i, labels == c] for c in set(labels.tolist())}
            means = {c: np.nansum(d) / (len(d) - (c == own) if len(d) > 1 else 1) for c, d in total.items() if not np.isnan(d).all()}
            others = [v for c, v in means.items() if c != own]
            a, b = means.get(own), min(others, default=None)
            out.append((b - a) / max(a, b) if b is not None and (labels == own).sum() > 1 and max(a, b) else 0.0)
        return np.mean(out)

    df = spark.createDataFrame(rows, "features array<double>, three int, gaps int, one int").repartition(3)
    for size in (silhouette.BLOCK_ROWS, 25):
        got = {r.assignment: r for r in silhouettes(df, ["three", "gaps", "one"], block_rows=size).collect()}
        for k, name in ((1, "three"), (2, "gaps"), (3, "one")):
            assert got[name].n == 90 and got[name].silhouette == pytest.approx(plain(np.array([r[k] for r in rows])), abs=1e-9)
    only = df.where("features[1] IS NULL")
    assert [(r.silhouette, r.n) for r in silhouettes(only, ["three", "one"]).collect()] == [(0.0, 3), (0.0, 3)]


def test_sweep(frame):
    sweep = cluster.kmeans_sweep(frame, range(2, 7), starts=3)
    assert sweep.best_k == 4 and [r.k for r in sweep.table.collect()] == [2, 3, 4, 5, 6]
    inertia = [r.inertia for r in sweep.table.collect()]
    assert inertia == sorted(inertia, reverse=True)
