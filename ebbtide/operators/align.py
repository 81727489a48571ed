"""Bring a frame to the feature list a model expects."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from ebbtide.functions.text import literal, name


class Alignment(NamedTuple):
    filled: list[str]
    dropped: list[str]


def alignment(df: DataFrame, feature_names: list[str], keep: list[str] = ()) -> Alignment:
    """Names that alignment will fill in, and names it will drop."""
    present = set(df.columns)
    return Alignment(
        [f for f in feature_names if f not in present],
        [c for c in df.columns if c not in feature_names and c not in keep],
    )


def align_features(
    df: DataFrame,
    feature_names: list[str],
    fill: float | dict[str, float] = 0,
    keep: list[str] = (),
) -> DataFrame:
    """Absent features take ``fill``, extra columns go, order is that of the list."""
    if not feature_names:
        raise ValueError("the list of expected features is empty")
    present = set(df.columns)
    values = fill if isinstance(fill, dict) else dict.fromkeys(feature_names, fill)
    return df.selectExpr(
        *[name(k) for k in keep],
        *[name(f) if f in present else f"{literal(values.get(f, 0))} AS {name(f)}" for f in feature_names],
    )
