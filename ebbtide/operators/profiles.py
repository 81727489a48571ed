"""The sample customer and four risk profiles as encoded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbtide.functions.text import name
from ebbtide.schema import RISK_PROFILES, SAMPLE_ENCODED, SAMPLE_NUMERIC


def sample_customer() -> dict[str, float]:
    return {**SAMPLE_NUMERIC, **SAMPLE_ENCODED}


def risk_profiles(spark: SparkSession) -> DataFrame:
    """One row per profile: the sample customer with the profile's own values."""
    base = sample_customer()
    rows = [[profile, *[float(v) for v in {**base, **own}.values()]] for profile, own in RISK_PROFILES.items()]
    schema = "profile string, " + ", ".join(f"{name(c)} double" for c in base)
    return spark.createDataFrame(rows, schema)

