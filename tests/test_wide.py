"""Columns with very many levels, and components of the vectors they make."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from ebbtide.operators import pca
from ebbtide.operators.levels import assemble_wide, fit_level_table, level_positions
from ebbtide.operators.wide_pca import fit_wide_pca
from ebbtide.schema import ID


def test_positions_are_ranks(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, None, "x"), (4, "ß", "y"), (5, "b", "x"), (6, "B", "")]
    df = spark.createDataFrame(rows, f"{ID} long, c string, d string").repartition(4)
    levels = fit_level_table(df, ["c", "d"], repair=False)
    assert levels.sizes == {"c": 4, "d": 3}
    got = {(r["column"], r.level): r.position for r in levels.table.collect()}
    assert got == {("c", "B"): 0, ("c", "a"): 1, ("c", "b"): 2, ("c", "ß"): 3, ("d", ""): 0, ("d", "x"): 1, ("d", "y"): 2}
    fresh = spark.createDataFrame([(9, "b", "new"), (10, None, "y")], f"{ID} long, c string, d string")
    assert {r[ID]: (r.c_position, r.d_position) for r in level_positions(fresh, levels).collect()} == {9: (2, None), 10: (None, 2)}
    named = fit_level_table(df, ["c"])
    assert named.sizes == {"c": 5} and {r.level for r in named.table.collect()} == {"B", "Unknown", "a", "b", "ß"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, 2.5, "b", "x"), (2, None, "a", None), (3, 0.0, None, "y")], f"{ID} long, n double, c string, d string")
    levels = fit_level_table(df, ["c", "d"], repair=False)
    got = {r[ID]: r.features for r in assemble_wide(df, ["n"], levels, [ID]).collect()}
    assert all(isinstance(v, SparseVector) and v.size == 5 for v in got.values())
    assert got[1] == Vectors.sparse(5, [0, 2, 3], [2.5, 1, 1]) and np.isnan(got[2][0]) and got[2][1] == 1 and got[2].numNonzeros() == 2
    assert got[3].toArray().tolist() == [0, 0, 0, 0, 1]
    none = fit_level_table(df.where("false"), ["c"], repair=False)
    assert assemble_wide(df, ["n"], none, [ID]).first().features.size == 1


def test_a_million_levels_reach_a_model(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias(ID), F.sha2(F.col("id").cast("string"), 256).alias("code"),
                               (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("double").alias("y"))
    levels = fit_level_table(df, ["code"], repair=False)
    assert levels.sizes == {"code": n}
    about = levels.table.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(about) == (0, n - 1, n)
    ordered = levels.table.where("position % 99991 = 0").orderBy("position").select("level").collect()
    assert [r.level for r in ordered] == sorted(r.level for r in ordered)
    rows = assemble_wide(df.where(f"{ID} % 50 = 0"), ["x"], levels, [ID, "y"])
    assert rows.first().features.size == n + 1
    assert "attrs" not in str(rows.schema["features"].metadata)
    model = LogisticRegression(labelCol="y", maxIter=3).fit(rows)
    assert model.numFeatures == n + 1 and model.coefficients[0] > 0


@pytest.fixture(scope="module")
def sparse_rows(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(300):
        c, d = int(draw.integers(0, 12)), int(draw.integers(0, 4))
        rows.append((i, float(draw.normal() + d), float(draw.normal() * 2 + c * 0.3), f"c{c}", f"d{d}"))
    df = spark.createDataFrame(rows, f"{ID} long, u double, v double, c string, d string").repartition(4)
    return assemble_wide(df, ["u", "v"], fit_level_table(df, ["c", "d"], repair=False), [ID])


def dense(rows):
    return np.array([r.features.toArray() for r in rows.orderBy(ID).collect()])


def test_components_equal_the_dense_ones(sparse_rows):
    x = dense(sparse_rows)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    wide = fit_wide_pca(sparse_rows, 4)
    assert np.allclose(wide.ratios, values[:4] / values.sum(), rtol=1e-6)
    assert np.allclose(wide.ratios, pca.fit_pca(sparse_rows, 4).ratios, rtol=1e-6)
    scores = np.array([[r.pc1, r.pc2, r.pc3, r.pc4] for r in wide.project(sparse_rows).orderBy(ID).collect()])
    assert np.allclose(scores.mean(0), 0, atol=1e-9) and np.allclose(np.cov(scores.T), np.diag(values[:4]), atol=1e-5)


def test_rows_of_zeros_and_dense_vectors(spark):
    rows = [(i, Vectors.dense([i % 3, 0.0, (i * 7) % 5]) if i % 4 else Vectors.sparse(3, {})) for i in range(60)]
    df = spark.createDataFrame(rows, [ID, "features"])
    x = dense(df)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    wide = fit_wide_pca(df, 2)
    assert np.allclose(wide.ratios, values[:2] / values.sum()) and wide.project(df).count() == 60
    scores = np.array([[r.pc1, r.pc2] for r in wide.project(df).orderBy(ID).collect()])
    assert np.allclose(np.abs(np.cov(scores.T)), np.diag(values[:2]), atol=1e-9)


def test_missing_values_count_as_the_mean_of_their_feature(spark):
    draw = np.random.default_rng(5)
    x = np.column_stack([draw.normal(3, 2, 80), draw.integers(0, 2, 80), draw.normal(size=80)])
    x[::7, 0], x[3::11, 2], x[:5, 1] = np.nan, np.nan, 0
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x.tolist())], [ID, "features"]).repartition(3)
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    wide = fit_wide_pca(df, 3)
    assert np.allclose(wide.ratios, values / values.sum())
    scores = np.array([[r.pc1, r.pc2, r.pc3] for r in wide.project(df).collect()])
    assert np.allclose(np.abs(np.cov(scores.T)), np.diag(values), atol=1e-9) and np.allclose(scores.mean(0), 0, atol=1e-9)


def test_a_feature_without_any_value_adds_nothing(spark):
    x = [(i, Vectors.dense([float("nan"), i % 4, (i * 7) % 5])) for i in range(40)]
    wide = fit_wide_pca(spark.createDataFrame(x, [ID, "features"]), 2)
    values = np.linalg.eigvalsh(np.cov(np.array([[i % 4, (i * 7) % 5] for i in range(40)]).T))[::-1]
    assert np.allclose(wide.ratios, values / values.sum())


def test_nothing_to_find(spark, sparse_rows):
    same = spark.createDataFrame([(i, Vectors.dense([1.0, 0.0])) for i in range(5)], [ID, "features"])
    assert fit_wide_pca(same, 2).ratios == [] and fit_wide_pca(sparse_rows.limit(0), 2).ratios == []
