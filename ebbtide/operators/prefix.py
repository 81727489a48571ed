"""Running totals over a global order without a single-task window.

The order column is cut into cells at approximate quantiles; exactness does not depend on
where the cuts fall.  Each cell gets its own window, and the totals of the cells before it
(one row per cell) are added.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.sources.staging import stage

ROWS_PER_CELL = 500_000
MAX_CELLS = 4_096


def running_totals(
    df: DataFrame, order_col: str, value_cols: list[str], rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Add ``cum_<v>`` (descending order, own row included) and ``next_<v>`` per value.

    ``df`` must hold each order value once.  ``next_<v>`` is the value of the following
    row, NULL on the last one; ``is_first`` and ``is_last`` mark the ends.
    """
    cells = min(MAX_CELLS, -(-df.count() // rows_per_cell))
    edges: list[float] = []
    if cells > 1:
        df = stage(df, "ordered")  # read by the quantiles, the totals and the windows
        cuts = df.approxQuantile(order_col, [i / cells for i in range(1, cells)], 0.25 / cells)
        edges = sorted(set(cuts))
    if not edges:
        # Few rows, by count: one cell, nothing comes before it.
        one = Window.orderBy(F.desc(order_col))
        return _numbered(df, value_cols, one)

    splits = [-float("inf"), *edges, float("inf")]
    celled = Bucketizer(splits=splits, inputCol=order_col, outputCol="__cell").transform(df)
    celled = celled.withColumn("__cell", -F.col("__cell"))
    first = F.max_by(F.struct(*value_cols), order_col).alias("first")
    totals = celled.groupBy("__cell").agg(first, *[F.sum(v).alias(f"t_{v}") for v in value_cols])
    # One row per cell: a plain window over at most MAX_CELLS rows.
    over_cells = Window.orderBy("__cell")
    before = over_cells.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__cell",
        *[F.coalesce(F.sum(f"t_{v}").over(before), F.lit(0)).alias(f"off_{v}") for v in value_cols],
        F.lead("first").over(over_cells).alias("following"),
        (F.row_number().over(over_cells) == 1).alias("first_cell"),
    )
    in_cell = Window.partitionBy("__cell").orderBy(F.desc(order_col))
    joined = celled.join(F.broadcast(offsets), "__cell")
    return _numbered(joined, value_cols, in_cell, df.columns)


def _numbered(
    df: DataFrame, value_cols: list[str], window: Window, columns: list[str] | None = None
) -> DataFrame:
    """Running totals inside the window, plus the offsets of the cells if there are any."""
    split = columns is not None
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.lead(F.struct(*value_cols)).over(window)
    first = F.row_number().over(window) == 1
    out = df.withColumns({
        **{f"cum_{v}": F.sum(v).over(upto) + (F.col(f"off_{v}") if split else 0) for v in value_cols},
        "__next": F.coalesce(following, F.col("following")) if split else following,
        "is_first": F.col("first_cell") & first if split else first,
    })
    return out.select(
        *(columns or df.columns), *[f"cum_{v}" for v in value_cols],
        *[F.col(f"__next.{v}").alias(f"next_{v}") for v in value_cols],
        "is_first", F.col("__next").isNull().alias("is_last"))
