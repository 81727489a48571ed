"""SQL text helpers for wide projections, where one string is planned faster than many calls."""

from __future__ import annotations


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(value: str | float | int | None) -> str:
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def replacing(columns: list[str], changed: dict[str, str]) -> list[str]:
    """Select list that keeps the column order, with some columns computed anew or added."""
    kept = [f"{changed[c]} AS {name(c)}" if c in changed else name(c) for c in columns]
    return kept + [f"{e} AS {name(c)}" for c, e in changed.items() if c not in columns]
