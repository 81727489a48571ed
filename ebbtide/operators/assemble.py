"""Feature columns to vectors and back."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from ebbtide.functions.text import name

FEATURES = "features"


def assemble(
    df: DataFrame, feature_names: list[str], keep: list[str] = (), allow_missing: bool = False
) -> DataFrame:
    """``keep`` columns plus one vector; the vector's metadata holds the names.

    ``allow_missing`` turns a missing value into NaN in the vector, where the assembler
    would otherwise fail the whole job.
    """
    inputs = feature_names
    if any("." in f or "`" in f for f in feature_names):
        # The assembler reads a dot as a nested field: give it plain names.
        inputs = [f"__f{i}" for i in range(len(feature_names))]
        df = df.selectExpr(
            *[name(k) for k in keep], *[f"{name(f)} AS {i}" for f, i in zip(feature_names, inputs)])
    assembler = VectorAssembler(
        inputCols=inputs, outputCol=FEATURES, handleInvalid="keep" if allow_missing else "error")
    return assembler.transform(df).selectExpr(*[name(k) for k in keep], FEATURES)
