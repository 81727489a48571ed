"""Risk bands, texts and actions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.schema import (
    AT_RISK_SEGMENT, GAUGE_COLORS, GAUGE_EDGES, RISK_DESCRIPTIONS, RISK_LEVELS,
    RISK_RECOMMENDATIONS, RISK_THRESHOLDS, SEGMENT_ACTIONS, UNKNOWN,
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _banded(value: Column, edges: list[float], labels: list[str], missing: str | None) -> Column:
    """Label of the first edge above the value; a missing value gets its own label."""
    out = F.when(value.isNull() | F.isnan(value), missing)
    for edge, label in zip(edges, labels):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def risk_level(probability: Column | str) -> Column:
    return _banded(_col(probability), RISK_THRESHOLDS, RISK_LEVELS, UNKNOWN)


def risk_description(probability: Column | str, variant: str = "service") -> Column:
    return _banded(_col(probability), RISK_THRESHOLDS, RISK_DESCRIPTIONS[variant], None)


def risk_recommendation(probability: Column | str, variant: str = "service") -> Column:
    return _banded(_col(probability), RISK_THRESHOLDS, RISK_RECOMMENDATIONS[variant], None)


def gauge_band(probability: Column | str) -> Column:
    """Color of the five-band gauge (percent scale)."""
    return _banded(_col(probability) * 100, GAUGE_EDGES, GAUGE_COLORS, None)


def predictions_agree(main: Column | str, vote: Column | str) -> Column:
    return F.coalesce(_col(main) == _col(vote), F.lit(False))


def segment_action(df: DataFrame, segment_col: str = "RFMSegment", churn_col: str = "Churn") -> DataFrame:
    """Add the business segment and its recommended action.

    A churned customer belongs to the at-risk segment whatever the RFM segment is.  The
    action table has five fixed rows, so its broadcast never grows.
    """
    actions = df.sparkSession.createDataFrame(
        list(SEGMENT_ACTIONS.items()), "segment string, action string"
    )
    segment = F.when(F.col(churn_col) == 1, AT_RISK_SEGMENT).otherwise(F.col(segment_col))
    return df.withColumn("segment", segment).join(F.broadcast(actions), "segment", "left")
