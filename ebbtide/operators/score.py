"""Batch scoring with failures isolated per row, in one pass over the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.risk import (
    predictions_agree, risk_description, risk_level, risk_recommendation,
)
from ebbtide.functions.text import literal, name
from ebbtide.operators.assemble import assemble
from ebbtide.operators.train import predict, vote_with
from ebbtide.sources.cells import PROBLEMS, problem_texts
from ebbtide.sources.models import ModelSet


def score_batch(
    df: DataFrame,
    models: ModelSet,
    details: bool = False,
    texts: str | None = None,
    variant: str = "service",
    impute: bool = False,
    fill: str = "zero",
) -> DataFrame:
    """Input columns plus prediction, probability, risk level and success.

    A row with a missing feature value fails alone: prediction and probability are -1
    (``variant="api"``: NULL, probabilities rounded to 4 places), the level is Unknown and
    ``error`` names the features.  The vector carries NaN for such a row, so the input is
    read once instead of being split into good and failed rows.  A row whose cells did not all
    parse (``sources.cells``) fails as well, with column, text and cause in ``error``.
    ``details`` adds the vote; ``texts`` ("service" or "api") adds description and recommendation.
    """
    keep = list(df.columns)
    names = models.feature_names
    # An input column may share its name with a feature, so the row travels as one struct.
    held = df.select("*", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"))
    features = models.features.features(held, ["__row"], impute=impute, fill=fill)
    missing = ", ".join(
        f"CASE WHEN {name(f)} IS NULL OR isnan({name(f)}) THEN {literal(f)} END" for f in names)
    checked = features.selectExpr("*", f"array_compact(array({missing})) AS __missing")
    vectors = assemble(checked, names, keep=["__row", "__missing"], allow_missing=True)
    scored = predict(models.classifier, vectors, "__main_")
    if details and models.voters:
        scored = vote_with(models.voters, scored)
    if models.kmeans is not None:
        scored = models.kmeans.transform(scored)
    if models.regressor is not None:
        scored = models.regressor.transform(scored)

    ok = (F.size("__missing") == 0) & ~F.isnan("__main_probability")
    reasons = F.array(F.when(F.size("__missing") > 0, F.concat(F.lit("missing values: "), F.array_join("__missing", ", "))))
    if PROBLEMS in keep:
        unparsed = F.coalesce(F.col(f"__row.{PROBLEMS}"), F.array().cast("array<struct<column:string,text:string,cause:string>>"))
        ok &= F.size(unparsed) == 0
        reasons = F.concat(problem_texts(unparsed), reasons)
    failed = F.lit(-1) if variant == "service" else F.lit(None)
    probability = F.col("__main_probability")
    shown = F.round(probability, 4) if variant == "api" else probability
    level = F.when(ok, probability)
    out = {
        "churn_prediction": F.when(ok, F.col("__main_prediction")).otherwise(failed.cast("int")),
        "churn_probability": F.when(ok, shown).otherwise(failed.cast("double")),
        "churn_risk_level": risk_level(level),
        "success": ok,
        "error": F.when(~ok, F.array_join(F.array_compact(reasons), "; ")),
    }
    if texts:
        out["churn_risk_description"] = risk_description(level, texts)
        out["churn_recommendation"] = risk_recommendation(level, texts)
    if details and models.voters:
        vote = F.when(ok, F.col("voting_prediction"))
        out["voting_prediction"] = F.coalesce(vote, failed.cast("int"))
        out["predictions_agree"] = predictions_agree(F.when(ok, F.col("__main_prediction")), vote)
    if models.kmeans is not None:
        out["cluster"] = F.when(ok, F.col("cluster"))
    if models.regressor is not None:
        out["predicted_monetary"] = F.when(ok, F.col("predicted_monetary"))
    inputs = [F.col(f"__row.`{c}`").alias(c) for c in keep if c not in out]
    return scored.select(*inputs, *[v.alias(k) for k, v in out.items()])

