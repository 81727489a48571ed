"""A fitted model set on disk: features, classifier and the optional parts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.sql import SparkSession

from ebbtide.plans.features import FeatureModel
from ebbtide.sources.publish import commit, latest, new_folder

REQUIRED = ["features", "classifier"]


@dataclass
class ModelSet:
    """Everything scoring needs; only the features and the classifier are required."""

    features: FeatureModel
    classifier: Model
    voters: list[Model] = field(default_factory=list)
    kmeans: Model | None = None
    regressor: Model | None = None

    @property
    def feature_names(self) -> list[str]:
        return self.features.feature_names


def _parts(models: ModelSet) -> dict[str, Model]:
    parts = {"features": models.features, "classifier": models.classifier}
    parts.update({f"voter{i}": m for i, m in enumerate(models.voters)})
    if models.kmeans is not None:
        parts["kmeans"] = models.kmeans
    if models.regressor is not None:
        parts["regressor"] = models.regressor
    return parts


def save_models(models: ModelSet, path: str, spark: SparkSession) -> int:
    """Write all parts as a new version of the set and commit it; returns its number.

    Readers see the version before until the commit, whatever happens to the writer.
    """
    folder = new_folder(path, "versions")
    parts = _parts(models)
    for name, part in parts.items():
        PipelineModel([part]).write().save(f"{folder}/{name}")
    content = {"folder": folder, "parts": list(parts), "feature_names": models.feature_names}
    return commit(spark, path, content).number


def _manifest(path: str, spark: SparkSession, version: int | None) -> tuple[str, dict]:
    """Folder and content of a committed version, or of a set that was written without versions."""
    found = latest(spark, path, version)
    try:  # a plain manifest takes precedence: it was put there by hand
        plain = None if version is not None else json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()["value"])
    except AnalysisException:
        plain = None
    if plain is not None:
        return (found.content["folder"] if found else path), plain
    if found is None:
        raise FileNotFoundError(f"no model set at {path}")
    return found.content["folder"], found.content


def load_models(path: str, spark: SparkSession, version: int | None = None) -> ModelSet:
    """Load the last committed version of a model set, or the given one.

    An optional part that is not there is left out; one that is there and damaged is an error.
    """
    folder, manifest = _manifest(path, spark, version)
    loaded: dict[str, Model] = {}
    for name in manifest["parts"]:
        try:
            spark.read.text(f"{folder}/{name}/metadata").first()
        except AnalysisException:
            continue  # the part is not there
        loaded[name] = PipelineModel.load(f"{folder}/{name}").stages[0]
    absent = [r for r in REQUIRED if r not in loaded]
    if absent or not manifest.get("feature_names"):
        raise ValueError(f"required parts are missing: {absent or ['feature_names']}")
    voters = [m for n, m in sorted(loaded.items()) if n.startswith("voter")]
    return ModelSet(
        loaded["features"], loaded["classifier"], voters, loaded.get("kmeans"), loaded.get("regressor"))
