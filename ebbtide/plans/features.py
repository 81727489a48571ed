"""Feature building as an estimator: fit freezes levels, medians and scales.

The fitted model is a list of column expressions with literals, so scoring is one
projection that stays inside generated code, in batch and in a stream alike.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.features import engineer_features
from ebbtide.operators.align import align_features
from ebbtide.operators.clean import assert_no_strings, drop_columns, sentinel_to_null
from ebbtide.operators.encode import add_ip_class, fit_levels, one_hot, ordinal_encode
from ebbtide.functions.text import literal, name
from ebbtide.operators.impute import fit_medians, impute_median
from ebbtide.operators.scale import fit_scaler
from ebbtide.schema import (
    DROPPED_COLUMNS, ID, LABEL, NOMINAL_COLUMNS, numeric_fields, string_fields,
)


def prepare_columns(df: DataFrame, clean_codes: bool = True) -> DataFrame:
    """Steps that need no fitting, each applied where its columns are present."""
    if clean_codes:
        df = sentinel_to_null(df)
    return add_ip_class(ordinal_encode(engineer_features(df)))


class FeatureBuilder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fit the feature table of the classifiers.

    ``scaling``: ``all`` features, only the ``numeric`` ones, or ``none``.
    ``exclude``: raw columns to leave out.
    """

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    scaling = Param(Params._dummy(), "scaling", "all, numeric or none", TypeConverters.toString)
    exclude = Param(Params._dummy(), "exclude", "columns left out", TypeConverters.toListString)
    cleanCodes = Param(Params._dummy(), "cleanCodes", "error codes to NULL", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, labelCol=LABEL, scaling="all", exclude=(), cleanCodes=True):
        super().__init__()
        self._setDefault(labelCol=LABEL, scaling="all", exclude=[], cleanCodes=True)
        self._set(**{k: list(v) if k == "exclude" else v for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> FeatureModel:
        label, clean = self.getOrDefault("labelCol"), self.getOrDefault("cleanCodes")
        prepared = drop_columns(prepare_columns(df, clean), [*self.getOrDefault("exclude"), *DROPPED_COLUMNS])
        texts = string_fields(prepared.schema)
        # A missing category is a level of its own for the listed columns only.
        listed = [c for c in texts if c in NOMINAL_COLUMNS or c == "IPClass"]
        residual = [c for c in texts if c not in listed]
        levels = fit_levels(prepared, listed)
        residual_levels = fit_levels(prepared, residual, repair=False)
        numeric = [c for c in numeric_fields(prepared.schema) if c != label]
        medians = fit_medians(prepared, numeric)
        numeric = [c for c in numeric if medians[c] is not None]
        state = {
            "clean": clean, "label": label, "numeric": numeric,
            "levels": levels, "residual_levels": residual_levels,
            "medians": {c: medians[c] for c in numeric}, "scaler": {},
        }
        encoded = _encode(prepared, state)
        dummies = [f"{c}_{v}" for c, vs in {**levels, **residual_levels}.items() for v in vs]
        state["features"] = numeric + dummies
        scaling = self.getOrDefault("scaling")
        if scaling != "none":
            scaled = numeric if scaling == "numeric" else state["features"]
            filled = impute_median(encoded, state["medians"])
            state["scaler"] = {c: list(v) for c, v in fit_scaler(filled, scaled).items()}
        model = FeatureModel()
        model._set(state=json.dumps(state, ensure_ascii=False))
        return model


def _encode(df: DataFrame, state: dict) -> DataFrame:
    return one_hot(one_hot(df, state["levels"]), state["residual_levels"], repair=False)


class FeatureModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Frozen feature projection."""

    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    @property
    def feature_names(self) -> list[str]:
        return self.fitted["features"]

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in (ID, self.fitted["label"], "split", "fold") if c in df.columns]
        return self.features(df, keep)

    def features(
        self, df: DataFrame, keep: list[str] = (), impute: bool = True, fill: str = "zero"
    ) -> DataFrame:
        """Feature columns in model order after the ``keep`` columns.

        Features are encoded from the raw columns that are present, or taken as they are
        where the frame already holds them encoded.  An absent feature becomes 0 before
        scaling (``fill="median"``: its median).  ``impute=False`` leaves missing values
        in present columns missing, for row-wise failure at scoring.
        """
        state = self.fitted
        names = state["features"]
        kept = {k: f"__keep_{i}" for i, k in enumerate(keep)}
        held = df.withColumns({alias: F.col(f"`{k}`") for k, alias in kept.items()})
        encoded = _encode(prepare_columns(held, state["clean"]), state)
        if impute:
            encoded = impute_median(encoded, state["medians"])
        filler = state["medians"] if fill == "median" else 0
        aligned = align_features(encoded, names, filler, keep=list(kept.values()))
        assert_no_strings(aligned, ignore=list(kept.values()))
        scaler = state["scaler"]
        features = []
        for f in names:
            value = f"CAST({name(f)} AS DOUBLE)"
            if f in scaler:
                mean, deviation = scaler[f]
                value = f"({value} - {literal(mean)}) / {literal(deviation)}"
            features.append(f"{value} AS {name(f)}")
        return aligned.selectExpr(*[f"{a} AS {name(k)}" for k, a in kept.items()], *features)
