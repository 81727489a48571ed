"""Median and mode imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.text import literal, name, replacing
from ebbtide.operators.quantiles import quantiles
from ebbtide.schema import numeric_fields, string_fields


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def fit_medians(df: DataFrame, columns: list[str] | None = None, **quantile_options) -> dict[str, float | None]:
    """Median (mean of the middle two) per numeric column; None for an empty column."""
    columns = numeric_fields(df.schema) if columns is None else columns
    return {c: v[0] for c, v in quantiles(df, columns, [0.5], **quantile_options).items()}


def impute_median(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Fill missing numbers; imputed columns are doubles because a median may be fractional."""
    return df.selectExpr(*replacing(df.columns, {
        c: f"coalesce(CAST({name(c)} AS DOUBLE), {literal(m)})"
        for c, m in medians.items() if c in df.columns
    }))


def fit_modes(df: DataFrame, columns: list[str] | None = None) -> dict[str, str | None]:
    """Most frequent level per text column, the smallest one on a tie.

    Levels are counted before the largest count is taken, so no task holds a whole column.
    """
    columns = string_fields(df.schema) if columns is None else columns
    if not columns:
        return {}
    counts = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).alias("level")) for c in columns
    ])).alias("s")).select("s.*").filter("level is not null").groupBy("column", "level").count()
    best = counts.groupBy("column").agg(
        F.min_by("level", F.struct(-F.col("count"), F.col("level"))).alias("mode")).collect()
    modes: dict[str, str | None] = dict.fromkeys(columns)
    modes.update({r["column"]: r["mode"] for r in best})
    return modes


def impute_mode(df: DataFrame, modes: dict[str, str | None]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(_q(c), F.lit(m)) for c, m in modes.items() if c in df.columns and m is not None
    })
