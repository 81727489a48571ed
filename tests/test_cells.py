"""Files with bad cells: every other cell and row survives, and the cause is kept."""

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import train
from ebbtide.operators.score import score_batch
from ebbtide.plans import catalog, workflow
from ebbtide.plans.catalog import spoilt_lines
from ebbtide.schema import ID, RAW_SCHEMA
from ebbtide.sources import models as store
from ebbtide.sources.cells import problem_report, problem_texts, read_checked
from ebbtide.sources.staging import new_path
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("CustomerID", T.LongType()), ("Age", T.IntegerType()), ("Spend", T.DoubleType()), ("Joined", T.DateType()), ("Note", T.StringType()))])


def lines(spark, *rows):
    path = new_path(spark, "lines")
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


def read(spark, *rows, **options):
    out = read_checked(spark, lines(spark, *rows), SCHEMA, **options)
    return {r.CustomerID: r for r in out.withColumn("texts", problem_texts()).collect()}


def test_causes(spark):
    got = read(spark, "CustomerID,Age,Spend,Joined,Note",
               "1,30,1.5,2024-01-02,fine", "2,abc,1.5,2024-01-02,", "3,30.5,x,never,y", "4,35.0,,,", "5,99999999999,NaN,2024-01-02,z",
               '6,1,2,2024-01-02,"a, ""b"", c"', "7,1,2", "8,1,2,2024-01-02,a,b,c", '9,1,2,2024-01-02,"a, b",extra', "10, , ,,")
    assert [got[i].texts for i in (1, 4, 6, 10)] == [[]] * 4 and got[4].Age == 35 and got[6].Note == 'a, "b", c'
    assert got[2].texts == ["Age: not a number (abc)"] and got[2].Spend == 1.5 and got[2].Age is None
    assert got[3].texts == ["Age: not a whole number (30.5)", "Spend: not a number (x)", "Joined: not a date (never)"]
    assert got[5].texts == ["Age: out of range (99999999999)"] and got[5].Spend is None
    assert got[7].texts == ["too few cells: 3 of 5"] and got[7].Spend == 2 and got[7].problems[0].text == "7,1,2"
    assert got[8].texts == ["too many cells: 7 of 5"] and got[9].texts == ["too many cells: 6 of 5"]


def test_headers_match_by_name_and_separators_differ(spark):
    got = read(spark, "Other;Spend;CustomerID", "x;2,5;1", "y;2.5;2", separator=";")
    assert got[1].texts == ["Spend: not a number (2,5)"] and got[2].texts == [] and got[2].Other == "y"
    assert "Age" not in got[1].asDict()
    bare = read(spark, "1,30,1.5,2024-01-02,fine", header=False)
    assert bare[1].Age == 30
    assert read(spark, "CustomerID,Age,Spend,Joined,Note") == {}


def test_report(spark):
    path = lines(spark, "CustomerID,Age,Spend,Joined,Note", "1,a,1,,", "2,b,x,,", "3", "4,1", "5,1,1,,")
    got = {(r.column, r.cause): r.rows for r in problem_report(read_checked(spark, path, SCHEMA)).collect()}
    assert got == {("Age", "not a number"): 2, ("Spend", "not a number"): 1, (None, "too few cells"): 2}


@pytest.fixture(scope="module")
def models(ready):
    rows = ready.vectors("train")
    tiny = train.Settings(trees=5, forest_depth=3, iterations=3, max_iter=30)
    return store.ModelSet(ready.features, train.logistic_regression(rows.count(), tiny).fit(rows))


def test_a_bad_cell_fails_its_row_alone(spark, customers, models):
    path = new_path(spark, "spoilt")
    spoilt_lines(customers).write.text(path)
    for options in ({}, {"impute": True}, {"variant": "api"}):
        scored = score_batch(read_checked(spark, path, header=False), models, **options)
        plain = score_batch(customers, models, **options)
        both = scored.join(plain.select(ID, F.col("success").alias("was"), F.col("churn_probability").alias("p")), ID)
        assert both.count() == customers.count()
        spoilt = f"({ID} % 11 = 0 OR {ID} % 13 = 0 OR {ID} % 17 = 0 OR {ID} % 19 = 0)"
        assert both.where(f"success <> (was AND NOT {spoilt})").count() == 0
        assert both.where("success AND churn_probability <> p").count() == 0
        assert both.where(f"{ID} % 11 = 0 AND {ID} % 17 <> 0 AND error NOT LIKE '%Age: not a number (abc)%'").count() == 0
        assert both.where(f"{ID} % 17 = 0 AND error NOT LIKE 'too many cells%'").count() == 0


def test_uploaded_file_names_the_cause(spark, customers, models):
    header = ",".join(RAW_SCHEMA.names)
    one = spoilt_lines(customers.where(f"{ID} % 11 = 0 AND {ID} % 17 <> 0 AND {ID} % 19 <> 0").limit(1)).first().value
    out = workflow.score_file(spark, lines(spark, header, one), models, new_path(spark, "out"))
    row = spark.read.option("header", True).csv(out).first()
    assert row.success == "false" and row.error.startswith("Age: not a number (abc)")


def test_exports_in_one_second_do_not_meet(spark, sf_dir):
    from ebbtide.sources.tables import export_predictions
    base, df = new_path(spark, "exports"), spark.range(3)
    paths = {export_predictions(df, base) for _ in range(4)}
    assert len(paths) == 4
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        export_predictions(df, base, next(iter(paths)))
    assert catalog.export_predictions(spark, sf_dir).count() > 0
