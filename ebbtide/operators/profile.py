"""Profiling reports: every report is one narrow scan with map-side combined aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.text import literal, name
from ebbtide.operators.quantiles import quantiles
from ebbtide.schema import (
    BOX_COLUMNS, HISTOGRAM_COLUMNS, LABEL, OUTLIER_COLUMNS, VALUE_COUNT_COLUMNS, numeric_fields,
)

FENCE = 1.5


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def unpivot_aggregates(df: DataFrame, per_column: dict[str, dict[str, str]]) -> DataFrame:
    """One global aggregate over all columns (SQL texts), turned into one row per column."""
    wide = df.selectExpr(*[
        f"named_struct('column', {literal(c)}, "
        + ", ".join(f"'{out}', {expr}" for out, expr in exprs.items()) + f") AS s{i}"
        for i, (c, exprs) in enumerate(per_column.items())
    ])
    return wide.selectExpr(f"inline(array({', '.join(wide.columns)}))")


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def profile_dtypes(df: DataFrame) -> DataFrame:
    """Number of columns and of filled cells per type."""
    kinds = dict(df.dtypes)
    filled = unpivot_aggregates(df, {
        c: {"dtype": literal(kinds[c]), "filled": f"count({name(c)})"} for c in df.columns})
    return filled.groupBy("dtype").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("filled").alias("n_filled"))


def missing_report(df: DataFrame, order_by: str = "missing") -> DataFrame:
    """Missing count and percent of the columns that miss values, largest first."""
    counts = unpivot_aggregates(
        df, {c: {"total": "count(1)", "present": f"count({name(c)})"} for c in df.columns})
    report = counts.filter("present < total").selectExpr(
        "column", "total - present AS missing",
        "round((total - present) / total * 100, 2) AS percent")
    return report.orderBy(F.desc(order_by), "column")


def remaining_nulls(df: DataFrame) -> DataFrame:
    """Total of missing cells."""
    cells = " + ".join(f"(count(1) - count({name(c)}))" for c in df.columns)
    return df.selectExpr(f"{cells} AS missing")


def describe_numeric(df: DataFrame, columns: list[str] | None = None, **quantile_options) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear) and max per numeric column."""
    columns = columns or numeric_fields(df.schema)
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75], **quantile_options)
    per_column = {}
    for c in columns:
        v = f"CAST({name(c)} AS DOUBLE)"
        q25, q50, q75 = (literal(x) for x in quartiles[c])
        per_column[c] = {
            "n": f"count({v})", "mean": f"avg({v})", "std": f"stddev_samp({v})",
            "min": f"min({v})", "q25": q25, "q50": q50, "q75": q75, "max": f"max({v})",
        }
    return unpivot_aggregates(df, per_column)


def class_distribution(df: DataFrame, label: str = LABEL, by: str | None = None) -> DataFrame:
    """Rows and share per class, over the table or inside each value of ``by``."""
    if by is None:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("t")).scalar()
        return counts.withColumn("share", F.col("n") / total)
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("t"))
    return counts.join(totals, by).select(by, label, "n", (F.col("n") / F.col("t")).alias("share"))


def iqr_outliers(df: DataFrame, columns: list[str] = OUTLIER_COLUMNS, **quantile_options) -> DataFrame:
    """Rows strictly outside 1.5 interquartile ranges; nulls are no outliers."""
    columns = [c for c in columns if c in df.columns]
    quartiles = quantiles(df, columns, [0.25, 0.75], **quantile_options)
    per_column = {}
    for c in columns:
        low, high = _fences(*quartiles[c])
        per_column[c] = {
            "lower_fence": literal(low), "upper_fence": literal(high),
            "outliers": f"count_if({name(c)} < {literal(low)} OR {name(c)} > {literal(high)})",
        }
    return unpivot_aggregates(df, per_column)


def _fences(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    if q1 is None or q3 is None:
        return None, None
    reach = FENCE * (q3 - q1)
    return q1 - reach, q3 + reach


def box_stats(df: DataFrame, columns: list[str] = BOX_COLUMNS, **quantile_options) -> DataFrame:
    """Quartiles and whiskers (extreme values inside the fences) per column."""
    columns = [c for c in columns if c in df.columns]
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75], **quantile_options)
    per_column = {}
    for c in columns:
        q1, q2, q3 = quartiles[c]
        low, high = _fences(q1, q3)
        v, lo, hi = f"CAST({name(c)} AS DOUBLE)", literal(low), literal(high)
        inside = f"CASE WHEN {v} BETWEEN {lo} AND {hi} THEN {v} END"
        per_column[c] = {
            "whisker_low": f"min({inside})", "q1": literal(q1), "median": literal(q2),
            "q3": literal(q3), "whisker_high": f"max({inside})",
            "outliers": f"count_if({v} < {lo} OR {v} > {hi})",
        }
    return unpivot_aggregates(df, per_column)


def histogram(df: DataFrame, columns: list[str] = HISTOGRAM_COLUMNS, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, last bin closed, empty bins kept."""
    columns = [c for c in columns if c in df.columns]
    bounds = df.agg(*[
        F.struct(F.min(_q(c)).cast("double"), F.max(_q(c)).cast("double")).alias(f"b{i}")
        for i, c in enumerate(columns)
    ]).first()
    hits, frame = [], []
    for c, (low, high) in zip(columns, bounds):
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        frame.append((c, low, width))
        position = F.floor((_q(c).cast("double") - low) / (high - low) * bins).cast("int")
        last = F.when(position >= bins, bins - 1).otherwise(position)
        hits.append(F.struct(F.lit(c).alias("column"), last.alias("bin")))
    if not frame:
        return df.sparkSession.createDataFrame(
            [], "column string, bin int, bin_low double, bin_high double, n bigint")
    counts = (
        df.select(F.explode(F.array(*hits)).alias("h")).select("h.*")
        .filter("bin is not null").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    # columns x bins rows, whatever the table size
    grid = df.sparkSession.createDataFrame(frame, "column string, low double, width double").select(
        "column", "low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin",
        (F.col("low") + F.col("width") * F.col("bin")).alias("bin_low"),
        (F.col("low") + F.col("width") * (F.col("bin") + 1)).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, columns: list[str] = VALUE_COUNT_COLUMNS) -> DataFrame:
    """Rows per level, nulls excluded, most frequent first; all columns in one scan."""
    columns = [c for c in columns if c in df.columns]
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("level")) for c in columns
    ])).alias("s")).select("s.*")
    counts = stacked.filter("level is not null").groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.orderBy("column", F.desc("n"), "level")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row.

    Only an 8-byte hash per row is shuffled for the whole table; full rows are compared
    only where a hash occurs more than once.  Repeated hashes are pre-counted map-side,
    and the join side is broadcast only if its measured size allows.
    """
    row_hash = F.xxhash64(*[_q(c) for c in df.columns])
    hashed = df.withColumn("__hash", row_hash)
    repeated = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash")
    copies = (
        hashed.join(repeated, "__hash", "left_semi").groupBy(*[_q(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def preview(df: DataFrame, order_by: str = "CustomerID", n: int = 5) -> DataFrame:
    """First rows in a stated order; a top-k, not a global sort."""
    return df.orderBy(order_by).limit(n)
