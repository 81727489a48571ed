"""Exact quantiles (linear interpolation) that never gather a column in one task.

``percentile`` keeps every distinct value of a column in one aggregation buffer.  That is
fine for a table of known small size and used there.  Beyond ``BUFFER_ROWS`` the rank is
searched by histogram refinement: each pass counts the rows of a shrinking interval in a
fixed number of bins, map-side combined, until the bin of the rank holds one value.  Hot
values are plain counters, and the driver sees bins, never rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.text import name

BUFFER_ROWS = 1_000_000
BINS = 512


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    buffer_rows: int = BUFFER_ROWS,
    accuracy: int | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles per column, nulls ignored; ``accuracy`` asks for the approximate mode."""
    if not columns:
        return {}
    probs = "array(" + ", ".join(f"{float(p)!r}D" for p in probabilities) + ")"
    if accuracy is not None:
        call = f"percentile_approx(CAST({{}} AS DOUBLE), {probs}, {accuracy})"
    elif df.count() <= buffer_rows:
        call = f"percentile(CAST({{}} AS DOUBLE), {probs})"
    else:
        return _refined(df, columns, probabilities)
    (row,) = df.selectExpr(*[f"{call.format(name(c))} AS q{i}" for i, c in enumerate(columns)]).collect()
    return {
        c: list(row[i]) if row[i] is not None else [None] * len(probabilities)
        for i, c in enumerate(columns)
    }


def _refined(
    df: DataFrame, columns: list[str], probabilities: list[float], bins: int = BINS
) -> dict[str, list[float | None]]:
    data = df.selectExpr(*[f"CAST({name(c)} AS DOUBLE) AS v{i}" for i, c in enumerate(columns)])
    names = data.columns
    (stats,) = data.selectExpr(
        *[f"struct(count({v}), min({v}), max({v})) AS {v}" for v in names]).collect()

    # Zero-based ranks needed by each quantile: the two neighbours of its position.
    open_ranks: dict[tuple[str, int], tuple[float, float, int]] = {}
    found: dict[tuple[str, int], float] = {}
    for v in names:
        n, low, high = stats[v]
        for p in probabilities if n else []:
            position = p * (n - 1)
            for rank in {math.floor(position), math.ceil(position)}:
                if low == high:
                    found[v, rank] = low
                else:
                    open_ranks[v, rank] = (low, high, 0)

    while open_ranks:
        intervals = sorted({(v, low, high) for (v, _), (low, high, _) in open_ranks.items()})
        counted: dict[int, list] = {i: [] for i in range(len(intervals))}
        for row in _histogram(data, intervals, bins).collect():
            counted[row.i].append((row.low, row.high, row.n))
        still_open = {}
        for (v, rank), (low, high, below) in open_ranks.items():
            for bin_low, bin_high, n in sorted(counted[intervals.index((v, low, high))]):
                if rank < below + n:
                    if bin_low == bin_high:
                        found[v, rank] = bin_low
                    else:
                        still_open[v, rank] = (bin_low, bin_high, below)
                    break
                below += n
        open_ranks = still_open

    out = {}
    for c, v in zip(columns, names):
        n = stats[v][0]
        out[c] = []
        for p in probabilities:
            if not n:
                out[c].append(None)
                continue
            position = p * (n - 1)
            low, high = found[v, math.floor(position)], found[v, math.ceil(position)]
            out[c].append(low + (high - low) * (position - math.floor(position)))
    return out


def _histogram(data: DataFrame, intervals: list[tuple[str, float, float]], bins: int) -> DataFrame:
    """Rows per bin of every interval, with the smallest and largest value of the bin.

    The bin number grows with the value, so bins split the sorted order cleanly.
    """
    hits = ", ".join(
        f"CASE WHEN {v} BETWEEN {low!r}D AND {high!r}D THEN named_struct('i', {i}, 'bin', "
        f"least(floor(({v} / 2 - {low / 2!r}D) / {high / 2 - low / 2!r}D * {bins}), {bins - 1}), "
        f"'value', {v}) END"
        for i, (v, low, high) in enumerate(intervals)
    )
    return (
        data.selectExpr(f"explode(array_compact(array({hits}))) AS h")
        .groupBy("h.i", "h.bin")
        .agg(F.min("h.value").alias("low"), F.max("h.value").alias("high"),
             F.count(F.lit(1)).alias("n"))
    )
