"""Stratified splits, folds and samples without moving the table.

Rows are ordered inside each class by a hash key.  Instead of ranking all rows in a window
with as many partitions as classes, the key of each wanted rank is located by counting
keys per prefix, longer prefixes where needed.  A split is then a comparison with a few
literals: two narrow scans to fit, none of the wide rows is shuffled.

The row identity must be unique; copies of one identity always stay together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.hashing import shuffle_key
from ebbtide.schema import ID, LABEL

PREFIX_STEP = 3
GATHER_ROWS = 2_000
MAX_CLASSES = 1_000


def rank_cuts(
    df: DataFrame,
    key: Column,
    wanted: Callable[[int], list[int]],
    label: str | None = None,
    gather_rows: int = GATHER_ROWS,
) -> dict[object, list[str | None]]:
    """Per class, the key of each wanted rank (1-based, rank 0 gives None)."""
    classes = F.col(label) if label else F.lit(0)
    keyed = df.select(classes.alias("c"), key.alias("key")).filter("c is not null")
    totals = {
        r.c: r.n
        for r in keyed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    }
    if len(totals) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    ranks = {c: wanted(n) for c, n in totals.items()}
    # Open searches: (class, rank) -> (prefix, rows of the class before that prefix).
    search = {(c, r): ("", 0) for c, rs in ranks.items() for r in rs if r > 0}
    found: dict[tuple, str] = {}
    width = 0
    while search:
        width = min(width + PREFIX_STEP, 32)
        spots = sorted({(c, prefix) for (c, _), (prefix, _) in search.items()}, key=repr)
        hits = _within(keyed, spots)
        rows = hits.groupBy("c", F.substring("key", 1, width).alias("p")).agg(
            F.count(F.lit(1)).alias("n")).collect()
        narrowed, gather = {}, []
        for (c, rank), (prefix, before) in search.items():
            cells = sorted((r.p, r.n) for r in rows if r.c == c and r.p.startswith(prefix))
            for p, n in cells:
                if rank <= before + n:
                    if width == 32:
                        found[c, rank] = p
                    elif n <= gather_rows:
                        gather.append((c, rank, p, before))
                    else:
                        narrowed[c, rank] = (p, before)
                    break
                before += n
        if gather:
            last: dict[tuple, list[str]] = {}
            for r in _within(keyed, sorted({(c, p) for c, _, p, _ in gather}, key=repr)).collect():
                for c, p in {(c, p) for c, _, p, _ in gather}:
                    if r.c == c and r.key.startswith(p):
                        last.setdefault((c, p), []).append(r.key)
            for c, rank, p, before in gather:
                found[c, rank] = sorted(last[c, p])[rank - before - 1]
        search = narrowed
    return {c: [found[c, r] if r > 0 else None for r in rs] for c, rs in ranks.items()}


def _within(keyed: DataFrame, spots: list[tuple]) -> DataFrame:
    """Rows of the given (class, key prefix) pairs."""
    if all(prefix == "" for _, prefix in spots):
        return keyed
    test = F.lit(False)
    for c, prefix in spots:
        test = test | ((F.col("c") == c) & F.col("key").startswith(prefix))
    return keyed.filter(test)


def _half_up(x: float) -> int:
    return int(x + 0.5)


def _per_class(label: str, cuts: dict, of: Callable[[list], Column]) -> Column:
    out = F.when(F.lit(False), None)
    for c, values in sorted(cuts.items(), key=repr):
        out = out.when(F.col(label) == c, of(values))
    return out


def stratified_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = ID, label: str = LABEL
) -> DataFrame:
    """Add ``split``: in each class round(test_size x n) rows are ``test``."""
    key = shuffle_key(id_col, seed)
    cuts = rank_cuts(df, key, lambda n: [_half_up(test_size * n)], label)
    is_test = _per_class(label, cuts, lambda v: F.lit(False) if v[0] is None else key <= v[0])
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 42, id_col: str = ID, label: str = LABEL
) -> DataFrame:
    """Add ``fold`` 0..k-1: k near-equal consecutive key ranges inside each class."""
    return df.withColumn("fold", fold_column(df, k, seed, id_col, label))


def fold_column(
    fitted_on: DataFrame, k: int = 5, seed: int = 42, id_col: str = ID, label: str = LABEL
) -> Column:
    """Fold of a row, from key ranges that are balanced on the given rows."""
    key = shuffle_key(id_col, seed)

    def upper_ranks(n: int) -> list[int]:
        size, extra = divmod(n, k)
        return [size * (i + 1) + min(i + 1, extra) for i in range(k - 1)]

    cuts = rank_cuts(fitted_on, key, upper_ranks, label)
    fold = _per_class(label, cuts, lambda values: sum(
        (F.when(key > v, 1).otherwise(0) if v is not None else F.lit(1) for v in values), F.lit(0)))
    return fold.cast("int")


def sample_n(df: DataFrame, n: int = 3000, seed: int = 42, id_col: str = ID) -> DataFrame:
    """min(n, rows) rows without replacement, as a filter on the hash key."""
    key = shuffle_key(id_col, seed)
    cuts = rank_cuts(df, key, lambda rows: [min(n, rows)])
    if not cuts or cuts[0][0] is None:
        return df.limit(0)
    return df.filter(key <= cuts[0][0])
