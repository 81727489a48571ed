"""Reports over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.prefix import ROWS_PER_CELL, running_totals
from ebbtide.schema import HIGH_RISK_LEVELS, ID


def batch_summary(scored: DataFrame) -> DataFrame:
    """Predicted churn rate, mean probability and number of high-risk customers."""
    return scored.agg(
        F.avg("churn_prediction").alias("churn_rate"),
        F.avg("churn_probability").alias("avg_probability"),
        F.count_if(F.col("churn_risk_level").isin(HIGH_RISK_LEVELS)).alias("high_risk"))


def risk_distribution(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("churn_risk_level").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "churn_risk_level")


def score_counts(scored: DataFrame) -> DataFrame:
    """Total, successes and failures of a scored batch."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"))


def with_index(scored: DataFrame, order_col: str = ID, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """0-based position in the order of a unique numeric column, on request only.

    Numbered cell by cell, so no task holds the whole batch.
    """
    ordered = scored.withColumns({"__falling": -F.col(order_col).cast("double"), "__one": F.lit(1)})
    counted = running_totals(ordered, "__falling", ["__one"], rows_per_cell)
    return counted.select((F.col("cum___one") - 1).alias("index"), *scored.columns)
