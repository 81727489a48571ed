"""Engineered features and category codes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.schema import PRIVATE_PREFIXES, TYPO, TYPO_FIX, UNKNOWN


def repaired(value: Column) -> Column:
    """Missing category becomes Unknown, the known typo is corrected."""
    return F.when(value.isNull(), UNKNOWN).when(value == TYPO, TYPO_FIX).otherwise(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is missing where the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0))


def _engineered() -> dict[str, tuple[list[str], Column]]:
    c = F.col
    return {
        "AvgValuePerTransaction": (
            ["MonetaryAvg", "AvgQuantityPerTransaction"],
            ratio(c("MonetaryAvg"), c("AvgQuantityPerTransaction"))),
        "MonetaryCV": (
            ["MonetaryStd", "MonetaryAvg"],
            c("MonetaryStd") / (F.abs(c("MonetaryAvg")) + F.lit(1e-6))),
        "ReturnRatioSquared": (["ReturnRatio"], c("ReturnRatio") * c("ReturnRatio")),
        "BasketDepth": (
            ["AvgLinesPerInvoice", "AvgQuantityPerTransaction"],
            ratio(c("AvgLinesPerInvoice"), c("AvgQuantityPerTransaction"))),
        "CancellationRate": (
            ["CancelledTransactions", "TotalTransactions"],
            c("CancelledTransactions") / (c("TotalTransactions") + 1)),
    }


ENGINEERED_COLUMNS = [
    "AvgValuePerTransaction", "MonetaryCV", "ReturnRatioSquared", "BasketDepth", "CancellationRate",
]


def engineer_features(df: DataFrame) -> DataFrame:
    """Add every ratio whose inputs are present."""
    present = set(df.columns)
    return df.withColumns({
        name: expr for name, (inputs, expr) in _engineered().items() if present.issuperset(inputs)
    })


def ordinal_code(value: Column, levels: list[str]) -> Column:
    """Position in the list; Unknown, appended last, takes everything unlisted."""
    listed = levels if UNKNOWN in levels else [*levels, UNKNOWN]
    position = F.array_position(F.array(*[F.lit(x) for x in listed]), repaired(value))
    fallback = listed.index(UNKNOWN) + 1
    return (F.coalesce(F.nullif(position, F.lit(0)), F.lit(fallback)) - 1).cast("int")


def mapped_code(value: Column, codes: dict[str, int]) -> Column:
    """Explicit code per level, 0 for everything else."""
    out = reduce(
        lambda chain, item: chain.when(value == item[0], item[1]), codes.items(), F.when(F.lit(False), 0)
    )
    return out.otherwise(0)


def ip_class(ip: Column) -> Column:
    """Coarse address class; the order of the rules matters."""
    value = F.coalesce(ip, F.lit(UNKNOWN))
    first = F.substring_index(value, ".", 1)
    private = reduce(lambda a, b: a | b, [value.startswith(p) for p in PRIVATE_PREFIXES])
    numeric = F.when(first.rlike("^[0-9]+$"), first.try_cast("int"))
    return (
        F.when(private, "Class_A")
        .when(numeric.between(1, 126), "Class_B")
        .when(value != UNKNOWN, "Class_C")
        .otherwise(UNKNOWN)
    )
