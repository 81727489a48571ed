"""Row-local cleaning steps and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.schema import DROPPED_COLUMNS, LABEL, SENTINELS, string_fields


def drop_columns(df: DataFrame, columns: list[str] = DROPPED_COLUMNS) -> DataFrame:
    """Drop the listed columns that are present."""
    return df.drop(*columns)


def split_target(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, DataFrame | None]:
    """Features and target; the target is optional."""
    return df.drop(label), df.select(label) if label in df.columns else None


def sentinel_to_null(df: DataFrame, codes: dict[str, list[int]] = SENTINELS) -> DataFrame:
    """Error codes are no measurements: turn them into NULL."""
    return df.withColumns({
        c: F.when(~F.col(c).isin(values), F.col(c))
        for c, values in codes.items() if c in df.columns
    })


def assert_no_strings(df: DataFrame, ignore: list[str] = ()) -> None:
    """Raise with the names of text columns left in a feature table."""
    left = [c for c in string_fields(df.schema) if c not in ignore]
    if left:
        raise ValueError(f"text columns left in the feature table: {left}")
