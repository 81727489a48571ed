"""Reproducible pseudo-random keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(id_col: str | Column, seed: int = 42) -> Column:
    """Uniform hex key of a row identity: the order stands in for a seeded permutation."""
    value = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(value.cast("string"), F.lit(f":{seed}")))


def unit_interval(value: Column) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits of the md5 of a text."""
    digits = F.substring(F.md5(value.cast("string")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))
