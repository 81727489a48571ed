"""Physical plans: pruned scans, no products, no single-task windows, no Python in hot paths."""

import pytest

from ebbtide import fixtures
from ebbtide.functions import risk
from ebbtide.operators import profile, split
from ebbtide.operators.score import score_batch
from ebbtide.plans import catalog


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_only_needed_columns_are_read(customers):
    text = plan(profile.class_distribution(customers))
    assert "ReadSchema: struct<Churn:int>" in text


def test_filters_reach_the_scan(customers):
    assert "GreaterThan(Recency,365)" in plan(customers.filter("Recency > 365").select("CustomerID"))


def test_unused_line_columns_drop_their_joins(spark, sf_dir):
    assert "lineitem" not in plan(fixtures.customers(spark, sf_dir).select("CustomerID", "Churn"))


@pytest.mark.parametrize("key", ["customers", "class_distribution", "duplicate_rows", "stratified_split", "roc_auc"])
def test_no_products(spark, sf_dir, key):
    text = plan(catalog.QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_split_moves_no_rows(customers):
    text = plan(split.stratified_split(customers))
    assert "Exchange" not in text and "Window" not in text


def test_scoring_is_one_scan_without_python(customers, ready):
    rows = ready.vectors("train")
    from ebbtide.operators import train
    from ebbtide.sources.models import ModelSet

    model = train.logistic_regression(rows.count(), train.Settings(max_iter=5)).fit(rows)
    text = plan(score_batch(customers, ModelSet(ready.features, model)))
    assert text.count("Scan parquet") == 2  # the node and its detail section
    assert "Exchange" not in text and "Python" not in text


def test_segment_action_broadcasts_five_rows(customers):
    assert "BroadcastHashJoin" in plan(risk.segment_action(customers))


def test_customers_copy_no_rows_for_their_distinct_counts(spark, sf_dir):
    text = plan(fixtures.customers(spark, sf_dir))
    assert "Expand" not in text and "ShuffledHashJoin" in text


def test_distinct_counts_with_repeated_and_missing_keys(spark):
    orders = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8), (4, None)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame(
        [(1, 10, 5), (1, 11, 5), (2, 10, 6), (2, None, None), (3, 99, 99), (4, 10, 5)], "l_orderkey long, l_partkey long, l_suppkey long")
    part = spark.createDataFrame([(10, "a"), (10, "b"), (11, "a"), (12, "c"), (None, "d")], "p_partkey long, p_name string")
    supplier = spark.createDataFrame([(5, 1), (5, 2), (6, 1), (6, None)], "s_suppkey long, s_nationkey int")
    found = fixtures._variety_columns(orders, lines, part, supplier).where("k IS NOT NULL").collect()
    assert sorted(map(tuple, found)) == [(7, 2, 2, 2), (8, 1, 0, 0)]


def test_lines_move_twice(spark, sf_dir):
    """Once to their order and once to their customer, whose distinct counts need no further shuffle."""
    text = plan(fixtures.customers(spark, sf_dir))
    assert sum("l_partkey" in part and "hashpartitioning" in part for part in text.split("\n\n")) == 2


def test_hot_customers_count_as_others(spark, sf_dir):
    orders, lines, part, supplier = (fixtures.table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "supplier"))
    lines = lines.unionByName(lines.limit(50))
    some = orders.groupBy("o_custkey").count().selectExpr("percentile(count, 0.5)").first()[0]
    together, spread = (
        sorted(map(tuple, fixtures._line_columns(orders, lines, part, supplier, n).collect())) for n in (10 ** 9, int(some)))
    assert together == spread and len(together) > 100
