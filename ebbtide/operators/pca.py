"""Principal components of centred feature vectors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.assemble import FEATURES


class Components(NamedTuple):
    model: PipelineModel
    ratios: list[float]

    def project(self, df: DataFrame) -> DataFrame:
        """Add pc1..pck; with a single component pc2 is 0, for a plot in two dimensions."""
        out = self.model.transform(df).drop("__centred")
        scores = vector_to_array("__components")
        k = len(self.ratios)
        columns = {f"pc{i + 1}": scores[i] for i in range(k)}
        if k == 1:
            columns["pc2"] = F.lit(0.0)
        return out.withColumns(columns).drop("__components")


def fit_pca(df: DataFrame, k: int = 2) -> Components:
    """Centre, then project: the library's projection does not centre by itself."""
    model = Pipeline(stages=[
        StandardScaler(withMean=True, withStd=False, inputCol=FEATURES, outputCol="__centred"),
        PCA(k=k, inputCol="__centred", outputCol="__components"),
    ]).fit(df)
    return Components(model, [float(x) for x in model.stages[-1].explainedVariance.toArray()])


def variance_table(spark, ratios: list[float], top: int | None = None) -> DataFrame:
    """Explained share and running share per component (one row per component)."""
    rows, total = [], 0.0
    for i, ratio in enumerate(ratios, start=1):
        total += ratio
        rows.append((i, ratio, total))
    return spark.createDataFrame(rows[:top], "component int, ratio double, cumulative double")


def components_for(ratios: list[float], share: float = 0.95) -> int:
    """Smallest number of components that explains ``share``; 1 if none does."""
    total = 0.0
    for i, ratio in enumerate(ratios, start=1):
        total += ratio
        if total >= share:
            return i
    return 1
