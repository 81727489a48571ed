"""K-means: sweep over k, assignment and cluster sizes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.assemble import FEATURES
from ebbtide.operators.kmeans import Centres, best_runs, fit_runs
from ebbtide.operators.silhouette import silhouettes
from ebbtide.operators.train import SEED, persisted

STARTS, MAX_ITER = 10, 300


def fit_kmeans(df: DataFrame, k: int, starts: int = STARTS, seed: int = SEED, max_iter: int = MAX_ITER) -> Centres:
    """Model with the lowest cost of several starts, which share their scans."""
    with persisted(df.select(FEATURES)) as rows:
        return Centres.of(best_runs(fit_runs(rows, [k], starts, max_iter, seed=seed))[k])


class Sweep(NamedTuple):
    table: DataFrame
    best_k: int
    models: dict[int, Centres]


def kmeans_sweep(df: DataFrame, ks=range(2, 11), starts: int = STARTS, max_iter: int = MAX_ITER) -> Sweep:
    """Inertia and silhouette per k; the first largest silhouette wins.

    All k and starts share one scan per iteration, and the silhouettes of all k one pass over
    the pairs of blocks of points.
    """
    with persisted(df.select(FEATURES)) as rows:
        best = best_runs(fit_runs(rows, ks, starts, max_iter, seed=SEED))
        models = {k: Centres.of(run, f"k{k}") for k, run in best.items()}
        labelled = rows
        for model in models.values():
            labelled = model.transform(labelled)
        found = {r.assignment: r.silhouette for r in silhouettes(labelled, [f"k{k}" for k in models], FEATURES).collect()}
    rows_out = [(k, run.cost, found[f"k{k}"]) for k, run in sorted(best.items())]
    table = df.sparkSession.createDataFrame(rows_out, "k int, inertia double, silhouette double")
    return Sweep(table, max(rows_out, key=lambda r: r[2])[0], {k: Centres.of(run) for k, run in best.items()})


def assign_clusters(df: DataFrame, k: int = 4, starts: int = STARTS) -> DataFrame:
    return fit_kmeans(df, k, starts).transform(df)


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster")
