"""Standard scaling with the population deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ebbtide.functions.text import literal, name, replacing


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one scan; a zero deviation scales by 1."""
    if not columns:
        return {}
    (row,) = df.selectExpr(*[
        f"struct(avg(CAST({name(c)} AS DOUBLE)), stddev_pop(CAST({name(c)} AS DOUBLE))) AS s{i}"
        for i, c in enumerate(columns)
    ]).collect()
    return {c: (row[i][0] or 0.0, row[i][1] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.selectExpr(*replacing(df.columns, {
        c: f"({name(c)} - {literal(mean)}) / {literal(deviation)}"
        for c, (mean, deviation) in scaler.items() if c in df.columns
    }))
