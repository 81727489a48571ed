"""Scalar rules on hand-written edge cases."""

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import features, risk
from ebbtide.operators import clean, encode
from ebbtide.operators.align import align_features, alignment
from ebbtide.operators.validate import accepted, rejected, validate_requests
from ebbtide.schema import REQUEST_FIELDS


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_ip_class(spark):
    values = ["10.1.1.1", "172.16.5.5", "172.17.0.1", "192.168.0.1", "0.1.1.1", "126.1.1.1",
              "127.0.0.1", "abc", "", "99999999999.1", None]
    assert column(spark, values, "string", features.ip_class) == [
        "Class_A", "Class_A", "Class_C", "Class_A", "Class_C", "Class_B", "Class_C", "Class_C",
        "Class_C", "Class_C", "Unknown"]


def test_ordinal_code_with_and_without_known_inconnu(spark):
    values = ["a", "b", None, "Inconn", "other", "Unknown"]
    assert column(spark, values, "string", lambda v: features.ordinal_code(v, ["a", "b"])) == [0, 1, 2, 2, 2, 2]
    assert column(spark, values, "string", lambda v: features.ordinal_code(v, ["Inconnu", "a", "b"])) == [
        1, 2, 3, 0, 3, 3]
    assert column(spark, values, "string", lambda v: features.ordinal_code(v, ["Unknown", "a"])) == [
        1, 0, 0, 0, 0, 0]


def test_mapped_code(spark):
    codes = {"Faible": 1, "Élevé": 3, "Eleve": 3}
    assert column(spark, ["Faible", "Eleve", "Élevé", "x", None], "string",
                  lambda v: features.mapped_code(v, codes)) == [1, 3, 3, 0, 0]


def test_engineered_ratios(spark):
    rows = spark.createDataFrame(
        [(10.0, 0.0, 5.0, 0.5, 4.0, 2, 0), (-10.0, None, 5.0, 0.5, 4.0, 2, 3), (0.0, 2.0, 5.0, None, 4.0, 2, 3)],
        "MonetaryAvg double, AvgQuantityPerTransaction double, MonetaryStd double, ReturnRatio double, "
        "AvgLinesPerInvoice double, CancelledTransactions int, TotalTransactions int")
    out = features.engineer_features(rows).collect()
    assert [r.AvgValuePerTransaction for r in out] == [None, None, 0.0]
    assert [r.BasketDepth for r in out] == [None, None, 2.0]
    assert [r.MonetaryCV for r in out] == [5 / (10 + 1e-6), 5 / (10 + 1e-6), 5 / 1e-6]
    assert [r.ReturnRatioSquared for r in out] == [0.25, 0.25, None]
    assert [r.CancellationRate for r in out] == [2.0, 0.5, 0.5]
    assert "CancellationRate" not in features.engineer_features(rows.drop("CancelledTransactions")).columns


def test_risk_bands(spark):
    values = [0.0, 0.2, 0.4, 0.6, 1.0, 0.19999, None, float("nan")]
    assert column(spark, values, "double", risk.risk_level) == [
        "Low", "Medium", "High", "Critical", "Critical", "Low", "Unknown", "Unknown"]
    assert column(spark, values, "double", risk.gauge_band) == [
        "lightgreen", "yellowgreen", "orange", "salmon", "red", "lightgreen", None, None]
    texts = column(spark, [0.1, 0.7, None], "double", lambda p: risk.risk_description(p, "api"))
    assert texts[0].startswith("Faible risque —") and texts[1].startswith("Risque critique —") and texts[2] is None


def test_agreement_of_missing_votes(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (None, None)], "a int, b int")
    assert [r.o for r in rows.select(risk.predictions_agree("a", "b").alias("o")).collect()] == [
        True, False, False, False]


def test_one_hot_variants(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "Inconn"), (4, "a")], "CustomerID int, Gender string")
    levels = encode.fit_levels(rows, ["Gender"])
    assert levels == {"Gender": ["Inconnu", "Unknown", "a", "b"]}
    full = encode.one_hot(rows, levels)
    assert {tuple(r)[1:] for r in full.collect()} == {(0, 0, 0, 1), (0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0)}
    residual, _ = encode.one_hot_residual(rows)
    assert residual.columns == ["CustomerID", "Gender_Inconn", "Gender_a", "Gender_b"]
    assert tuple(residual.filter("CustomerID = 2").first())[1:] == (0, 0, 0)
    dropped = encode.one_hot(rows, levels, drop_first=True, keep_source=True)
    assert dropped.columns == ["CustomerID", "Gender", "Gender_Unknown", "Gender_a", "Gender_b"]
    unseen = encode.one_hot(spark.createDataFrame([(9, "new")], "CustomerID int, Gender string"), levels)
    assert tuple(unseen.first())[1:] == (0, 0, 0, 0)


def test_level_limit_and_vector_form(spark):
    rows = spark.range(50).selectExpr("id AS CustomerID", "concat('v', id) AS code")
    with pytest.raises(ValueError, match="one_hot_vector"):
        encode.fit_levels(rows, ["code"], max_levels=10)
    vectors = encode.one_hot_vector(rows, ["code"]).transform(rows)
    assert vectors.first()["code_vector"].numNonzeros() == 1


def test_quotes_in_levels(spark):
    rows = spark.createDataFrame([(1, "Côte d'Ivoire"), (2, "a\\b")], "CustomerID int, Country string")
    out, levels = encode.one_hot_residual(rows)
    assert out.agg(*[F.sum(F.col(f"`Country_{v}`")) for v in levels["Country"]]).first()[:] == (1, 1)


def test_string_check(spark):
    rows = spark.createDataFrame([(1, "x")], "a int, left_over string")
    with pytest.raises(ValueError, match="left_over"):
        clean.assert_no_strings(rows)
    clean.assert_no_strings(rows, ignore=["left_over"])


def test_split_target(spark):
    rows = spark.createDataFrame([(1, 0)], "a int, Churn int")
    x, y = clean.split_target(rows)
    assert x.columns == ["a"] and y.columns == ["Churn"]
    assert clean.split_target(x)[1] is None


def test_alignment(spark):
    rows = spark.createDataFrame([(1, 2.0, "x")], "id int, b double, extra string")
    assert alignment(rows, ["a", "b"], keep=["id"]) == (["a"], ["extra"])
    assert align_features(rows, ["b", "a"]).columns == ["b", "a"]
    assert align_features(rows, ["a", "b"], fill={"a": 7.0}).first()["a"] == 7.0
    with pytest.raises(ValueError):
        align_features(rows, [])


def request(**changes):
    return {**{f.name: float(f.default) for f in REQUEST_FIELDS}, **changes}


def check(spark, rows, form=False):
    names = [f.name for f in REQUEST_FIELDS]
    frame = spark.createDataFrame(
        [(i, *[r[n] for n in names]) for i, r in enumerate(rows)],
        "i int, " + ", ".join(f"{n} double" for n in names))
    return validate_requests(frame, form)


@pytest.mark.parametrize("changes, rules", [
    ({}, []),
    ({"Recency": -1.0}, ["Recency>=0"]), ({"Frequency": -1.0}, ["Frequency>=0"]),
    ({"MonetaryTotal": -0.5}, ["MonetaryTotal>=0"]), ({"TotalQuantity": -1.0}, ["TotalQuantity>=0"]),
    ({"Age": 17.0}, ["Age>=18"]), ({"Age": 121.0}, ["Age<=120"]),
    ({"SupportTicketsCount": -1.0}, ["SupportTicketsCount>=0"]),
    ({"SatisfactionScore": 0.0}, ["SatisfactionScore>=1"]), ({"SatisfactionScore": 6.0}, ["SatisfactionScore<=5"]),
    ({"ReturnRatio": 1.5}, ["ReturnRatio<=1"]), ({"ReturnRatio": -0.1}, ["ReturnRatio>=0"]),
    ({"AvgDaysBetweenPurchases": -1.0}, ["AvgDaysBetweenPurchases>=0"]),
    ({"CustomerTenureDays": -1.0}, ["CustomerTenureDays>=0"]), ({"UniqueProducts": -1.0}, ["UniqueProducts>=0"]),
    ({"Recency": None}, ["Recency:required"]), ({"Recency": 1.5}, ["Recency:integer"]),
    ({"Recency": -2.0, "Age": 130.0}, ["Recency>=0", "Age<=120"]),
])
def test_request_rules(spark, changes, rules):
    assert check(spark, [request(**changes)]).first()["violations"] == rules


def test_form_is_stricter(spark):
    row = [request(Frequency=0.0, Age=110.0)]
    assert check(spark, row).first()["violations"] == []
    assert check(spark, row, form=True).first()["violations"] == ["Frequency>=1", "Age<=100"]


def test_defaults_fill_absent_columns_only(spark):
    partial = spark.createDataFrame([(1, 10), (2, None)], "i int, Recency int")
    out = validate_requests(partial)
    assert accepted(out).first()["Age"] == 35 and accepted(out).first()["ReturnRatio"] == 0.05
    assert [r.i for r in rejected(out).collect()] == [2]


def test_one_bad_request_does_not_reject_the_others(spark):
    out = check(spark, [request(), request(Age=5.0), request()])
    assert accepted(out).count() == 2 and rejected(out).count() == 1
