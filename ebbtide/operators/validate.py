"""Request rules: each row is accepted or rejected on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.schema import FORM_OVERRIDES, REQUEST_FIELDS, RequestField


def request_fields(form: bool = False) -> list[RequestField]:
    """Fields with their ranges; ``form=True`` takes the stricter data-entry ranges."""
    if not form:
        return REQUEST_FIELDS
    return [f._replace(**FORM_OVERRIDES.get(f.name, {})) for f in REQUEST_FIELDS]


def _rules(field: RequestField, kind: T.DataType) -> list[tuple[str, Column]]:
    value = F.col(field.name)
    number = value.try_cast("double") if isinstance(kind, T.StringType) else value.cast("double")
    broken = [(f"{field.name}:required", number.isNull())]
    if field.integral:
        broken.append((f"{field.name}:integer", number != F.floor(number)))
    if field.low is not None:
        broken.append((f"{field.name}>={field.low}", F.isnan(number) | (number < field.low)))
    if field.high is not None:
        broken.append((f"{field.name}<={field.high}", number > field.high))
    return broken


def validate_requests(df: DataFrame, form: bool = False) -> DataFrame:
    """Add ``violations``, the names of the broken rules; absent columns take defaults.

    A default replaces an absent column only: a missing value in a present column is a
    broken rule.
    """
    fields = request_fields(form)
    absent = {
        f.name: F.lit(f.default).cast("int" if f.integral else "double")
        for f in fields if f.name not in df.columns
    }
    out = df.withColumns(absent)
    checks = [
        F.when(broken, name)
        for f in fields for name, broken in _rules(f, out.schema[f.name].dataType)
    ]
    return out.withColumn("violations", F.array_compact(F.array(*checks)))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") == 0).drop("violations")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") > 0)
