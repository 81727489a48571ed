"""Pairwise-complete Pearson correlation of all numeric columns in one pass.

Several hundred column pairs as SQL aggregates overrun the size limit of generated code.
Here each Arrow batch turns into small matrix products, each task emits one row per column
pair, and Spark adds those rows up.  The shuffle holds tasks x pairs rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.schema import LABEL, numeric_fields

_PAIR_SCHEMA = (
    "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
)


def _pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of every pair i <= j over the rows where both values are present."""
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    # Shifting by the mean keeps the sums free of cancellation.
    means = doubles.agg(*[F.avg(v).alias(v) for v in doubles.columns]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(shift)
        total = np.zeros((6, width, width))
        for batch in batches:
            x = batch.to_numpy(dtype="float64") - shift
            present = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x)
            squares = x * x
            total += np.stack([
                present.T @ present, x.T @ present, present.T @ x,
                squares.T @ present, present.T @ squares, x.T @ x,
            ])
        i, j = np.triu_indices(width)
        sums = [total[s][i, j] for s in range(6)]
        yield pd.DataFrame(dict(zip(["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"], [i, j, *sums])))

    rows = doubles.mapInPandas(partial, _PAIR_SCHEMA)
    return rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])


def correlation_matrix(
    df: DataFrame, columns: list[str] | None = None, diagonal: bool = False
) -> DataFrame:
    """Correlation per column pair (``x_pos`` < ``y_pos``); NULL where a variance is zero."""
    columns = columns or numeric_fields(df.schema)
    c = F.col
    vx = c("sxx") - c("sx") * c("sx") / c("n")
    vy = c("syy") - c("sy") * c("sy") / c("n")
    cov = c("sxy") - c("sx") * c("sy") / c("n")
    # A constant column leaves rounding residue; compare with the size of its sums.
    usable = (c("n") > 1) & (vx > c("sxx") * 1e-13) & (vy > c("syy") * 1e-13)
    value = F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    names = F.array(*[F.lit(x) for x in columns])
    pairs = _pair_sums(df, columns)
    if not diagonal:
        pairs = pairs.filter("i < j")
    return pairs.select(
        F.get(names, c("i")).alias("x"), F.get(names, c("j")).alias("y"),
        c("i").alias("x_pos"), c("j").alias("y_pos"), value.alias("corr"))


def churn_correlation(df: DataFrame, target: str = LABEL, columns: list[str] | None = None) -> DataFrame:
    """Correlation of every column with the target, largest first, target included."""
    columns = columns or numeric_fields(df.schema)
    rows = correlation_matrix(df, columns, diagonal=True).filter(
        (F.col("x") == target) | (F.col("y") == target))
    other = F.when(F.col("x") == target, F.col("y")).otherwise(F.col("x"))
    return rows.select(other.alias("column"), "corr").orderBy(F.desc_nulls_last("corr"), "column")


def multicollinear(
    df: DataFrame, threshold: float = 0.8, columns: list[str] | None = None, target: str = LABEL
) -> DataFrame:
    """Columns strongly correlated with an earlier column; listed, not dropped."""
    rows = correlation_matrix(df, columns)
    return (
        rows.filter((F.abs("corr") > threshold) & (F.col("y") != target))
        .select(F.col("y").alias("column"), F.col("y_pos").alias("position")).distinct()
        .orderBy("position"))
