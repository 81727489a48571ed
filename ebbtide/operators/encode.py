"""Ordinal and one-hot encoding with levels frozen at fit time."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.features import ip_class, mapped_code, ordinal_code, repaired
from ebbtide.functions.text import literal, name, replacing
from ebbtide.schema import (
    IP_COLUMN, ORDINAL_CODES, ORDINAL_LEVELS, TYPO, TYPO_FIX, UNKNOWN, string_fields,
)

MAX_LEVELS = 2_000


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in string_fields(df.schema)]


def ordinal_encode(df: DataFrame, levels: dict[str, list[str]] = ORDINAL_LEVELS) -> DataFrame:
    """Overwrite text columns with their position in the list; numeric columns stay."""
    return df.withColumns({c: ordinal_code(F.col(c), levels[c]) for c in _text(df, levels)})


def ordinal_encode_mapped(df: DataFrame, codes: dict[str, dict[str, int]] = ORDINAL_CODES) -> DataFrame:
    """Add ``<column>_encoded`` with explicit codes, 0 for anything else."""
    return df.withColumns({f"{c}_encoded": mapped_code(F.col(c), codes[c]) for c in _text(df, codes)})


def fit_levels(
    df: DataFrame, columns: list[str], repair: bool = True, max_levels: int = MAX_LEVELS
) -> dict[str, list[str]]:
    """Sorted distinct levels per column, from one scan with map-side distinct.

    What reaches the driver is bounded: a column with more than ``max_levels`` levels
    raises; use ``one_hot_vector`` for such a column.
    """
    if not columns:
        return {}
    value = (lambda c: repaired(_q(c))) if repair else _q
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), value(c).alias("level")) for c in columns
    ])).alias("s")).select("s.*").filter("level is not null").distinct()
    sizes = stacked.groupBy("column").count().filter(F.col("count") > max_levels).limit(1).collect()
    if sizes:
        raise ValueError(f"{sizes[0]['column']} has more than {max_levels} levels: use one_hot_vector")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in stacked.collect():
        levels[row["column"]].append(row["level"])
    return {c: sorted(found) for c, found in levels.items()}


def one_hot(
    df: DataFrame,
    levels: dict[str, list[str]],
    repair: bool = True,
    drop_first: bool = False,
    keep_source: bool = False,
) -> DataFrame:
    """0/1 column ``<column>_<level>`` per frozen level; an unseen level gives all zeros."""
    columns = _text(df, levels)
    dummies = {}
    for c in columns:
        for level in levels[c][1:] if drop_first else levels[c]:
            hit = f"{name(c)} = {literal(level)}"
            if repair and level == UNKNOWN:
                hit += f" OR {name(c)} IS NULL"
            elif repair and level == TYPO_FIX:
                hit += f" OR {name(c)} = {literal(TYPO)}"
            dummies[f"{c}_{level}"] = f"CASE WHEN {hit} THEN 1 ELSE 0 END"
    kept = df.columns if keep_source else [c for c in df.columns if c not in columns]
    return df.selectExpr(*replacing(kept, dummies))


def one_hot_residual(df: DataFrame, ignore: list[str] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """Encode every text column left, without a level for missing values."""
    columns = [c for c in string_fields(df.schema) if c not in ignore]
    levels = fit_levels(df, columns, repair=False)
    return one_hot(df, levels, repair=False), levels


def one_hot_vector(df: DataFrame, columns: list[str]) -> PipelineModel:
    """Sparse one-hot vectors for columns with very many levels."""
    indexed = [f"{c}_index" for c in columns]
    return Pipeline(stages=[
        StringIndexer(inputCols=columns, outputCols=indexed, stringOrderType="alphabetAsc",
                      handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_vector" for c in columns], dropLast=False),
    ]).fit(df)


def add_ip_class(df: DataFrame) -> DataFrame:
    """Replace the address by its coarse class."""
    if IP_COLUMN not in df.columns:
        return df
    return df.withColumn("IPClass", ip_class(F.col(IP_COLUMN))).drop(IP_COLUMN)
