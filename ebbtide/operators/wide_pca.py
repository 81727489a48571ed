"""Principal components of sparse vectors of any length, by block subspace iteration.

Nothing as long as the vectors reaches the driver: the block of directions is a table with a row per
feature, products with the data are joins and sums, and centring is implicit (the means are
subtracted from products, not from the sparse rows).  The driver sees square matrices of the
block's width only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.hashing import unit_interval
from ebbtide.operators.assemble import FEATURES
from ebbtide.schema import ID
from ebbtide.sources.staging import stage

OVERSAMPLE, ROUNDS = 8, 8


def entries(df: DataFrame, id_col: str = ID, features: str = FEATURES) -> DataFrame:
    """``row, feature, value`` of all elements of the vectors that are not zero."""
    v = F.unwrap_udt(features)
    dense = F.transform(v["values"], lambda x, i: F.struct(i.alias("indices"), x.alias("values")))
    pairs = F.when(v["type"] == 0, F.arrays_zip(v["indices"].alias("indices"), v["values"].alias("values"))).otherwise(dense)
    return df.select(F.col(id_col).alias("row"), F.explode(pairs).alias("e")).select(
        "row", F.col("e.indices").alias("feature"), F.col("e.values").alias("value")).where("value <> 0")


def _filled(cells: DataFrame, means: DataFrame) -> DataFrame:
    """The elements with the mean of their feature in place of a missing value."""
    value = F.when(F.isnan("value"), F.coalesce("mean", F.lit(0.0))).otherwise(F.col("value"))
    return cells.join(means, "feature").select("row", "feature", value.alias("value"))


def _names(letter: str, width: int) -> list[str]:
    return [f"{letter}{j}" for j in range(width)]


def _gram(df: DataFrame, names: list[str]) -> np.ndarray:
    """Products of all pairs of columns, summed over the rows."""
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1)]
    row = df.agg(*[F.sum(F.col(names[a]) * F.col(names[b])).alias(f"g{i}") for i, (a, b) in enumerate(pairs)]).first()
    out = np.zeros((len(names), len(names)))
    for value, (a, b) in zip(row, pairs):
        out[a, b] = out[b, a] = value or 0.0
    return out


def _times(names: list[str], matrix: np.ndarray, letter: str) -> list[Column]:
    """Columns of ``names`` times a small matrix."""
    return [sum((F.col(n) * float(w) for n, w in zip(names, column)), F.lit(0.0)).alias(f"{letter}{j}") for j, column in enumerate(matrix.T)]


class WidePca(NamedTuple):
    loadings: DataFrame   # feature, mean, l0, l1, ...
    offsets: list[float]  # product of the means and each component
    ratios: list[float]

    def project(self, df: DataFrame, id_col: str = ID, features: str = FEATURES) -> DataFrame:
        """``id, pc1, pc2, ...`` of every row."""
        names = _names("l", len(self.ratios))
        filled = F.when(F.isnan("value"), F.col("mean")).otherwise(F.col("value"))
        sums = entries(df, id_col, features).join(self.loadings, "feature").groupBy("row").agg(
            *[F.sum(filled * F.col(n)).alias(n) for n in names])
        return df.select(F.col(id_col)).join(sums, F.col(id_col) == F.col("row"), "left").select(
            id_col, *[(F.coalesce(F.col(n), F.lit(0.0)) - o).alias(f"pc{j}") for j, (n, o) in enumerate(zip(names, self.offsets), start=1)])


def fit_wide_pca(df: DataFrame, k: int = 2, id_col: str = ID, features: str = FEATURES, oversample: int = OVERSAMPLE,
                 rounds: int = ROUNDS, seed: int = 42) -> WidePca:
    """The ``k`` first components of the centred rows; ``id_col`` must be unique.

    ``rounds`` steps of subspace iteration on ``k + oversample`` directions.  Fewer components
    come back where the rows span fewer directions.  A missing value counts as the mean of the
    values that its feature has in the other rows.
    """
    n = df.count()
    cells = stage(entries(df, id_col, features), "cells")
    gaps = F.count_if(F.isnan("value"))
    there = F.sum(F.when(~F.isnan("value"), F.col("value")))
    seen = cells.groupBy("feature").agg(gaps.alias("gaps"), F.when(gaps < n, there / (F.lit(n) - gaps)).alias("mean"))
    if seen.where("gaps > 0").limit(1).count():
        cells = stage(_filled(cells, seen.select("feature", "mean")).where("value <> 0"), "filled")
    about = stage(cells.groupBy("feature").agg((F.sum("value") / max(n, 1)).alias("mean"), F.sum(F.col("value") ** 2).alias("square")), "means")
    size, total = about.agg(F.count("*"), F.sum(F.col("square") - n * F.col("mean") ** 2)).first()
    if n < 2 or not total or total <= 0:
        return WidePca(about.select("feature", "mean").where("false"), [], [])
    total /= n - 1
    width = min(k + oversample, size)

    def gauss(j: int) -> Column:
        u, v = (unit_interval(F.concat_ws(":", F.lit(f"{seed}:{j}:{s}"), "feature")) for s in "uv")
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)

    block = about.select("feature", "mean", *[gauss(j).alias(f"z{j}") for j in range(width)])

    def orthonormal(block: DataFrame, width: int) -> tuple[DataFrame, int]:
        """The same span as orthonormal columns q; directions of no length are dropped."""
        block = stage(block, "block")
        lengths, axes = np.linalg.eigh(_gram(block, _names("z", width)))
        held = lengths > lengths.max() * 1e-13
        scale = axes[:, held] / np.sqrt(lengths[held])
        return stage(block.select("feature", "mean", *_times(_names("z", width), scale, "q")), "directions"), int(held.sum())

    def product(directions: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
        """Centred rows times the directions, and what was subtracted."""
        q = _names("q", width)
        offsets = np.array(directions.agg(*[F.sum(F.col("mean") * F.col(c)) for c in q]).first(), float)
        sums = cells.join(directions, "feature").groupBy("row").agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in q])
        return stage(sums.select("row", *[(F.col(c) - float(o)).alias(f"y{j}") for j, (c, o) in enumerate(zip(q, offsets))]), "scores"), offsets

    directions, width = orthonormal(block, width)
    for _ in range(rounds):
        scores, _ = product(directions, width)
        # The scores of all rows add up to zero, so the means drop out of this product.
        back = cells.join(scores, "row").groupBy("feature").agg(*[F.sum(F.col("value") * F.col(f"y{j}")).alias(f"z{j}") for j in range(width)])
        shifted = back.join(about.select("feature", "mean"), "feature").select("feature", "mean", *_names("z", width))
        directions, width = orthonormal(shifted, width)
    again, width = orthonormal(directions.select("feature", "mean", *[F.col(c).alias(f"z{j}") for j, c in enumerate(_names("q", width))]), width)
    scores, offsets = product(again, width)
    missing = n - scores.count()  # rows of zeros only
    spread = (_gram(scores, _names("y", width)) + missing * np.outer(offsets, offsets)) / (n - 1)
    variances, axes = np.linalg.eigh(spread)
    order = np.argsort(variances)[::-1][:k]
    chosen = axes[:, order] * np.where(axes[np.abs(axes[:, order]).argmax(0), order] < 0, -1.0, 1.0)
    loadings = stage(again.select("feature", "mean", *_times(_names("q", width), chosen, "l")), "loadings")
    return WidePca(loadings, (offsets @ chosen).tolist(), [float(max(variances[i], 0.0) / total) for i in order])

