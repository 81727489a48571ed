"""Evaluation tables on labels, predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.prefix import ROWS_PER_CELL, running_totals


def _share(part: Column, whole: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.when(whole == 0, 0.0).otherwise(part / F.when(whole != 0, whole))


def _f1(precision: Column, recall: Column) -> Column:
    return _share(2 * precision * recall, precision + recall)


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    cells = {f"n{a}{b}": F.count_if((y == a) & (p == b)) for a in (0, 1) for b in (0, 1)}
    return df.agg(*[v.alias(k) for k, v in cells.items()])


def confusion_matrix(df: DataFrame, label: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """Count of every (true, predicted) pair of classes, zero cells included."""
    cells = [
        F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(f"n{a}{b}").alias("n"))
        for a in (0, 1) for b in (0, 1)
    ]
    return _cells(df, label, prediction).select(F.inline(F.array(*cells)))


def _scores() -> dict[str, Column]:
    n00, n01, n10, n11 = (F.col(x) for x in ["n00", "n01", "n10", "n11"])
    precision = {0: _share(n00, n00 + n10), 1: _share(n11, n11 + n01)}
    recall = {0: _share(n00, n00 + n01), 1: _share(n11, n11 + n10)}
    return {
        **{f"precision{c}": precision[c] for c in (0, 1)},
        **{f"recall{c}": recall[c] for c in (0, 1)},
        **{f"f1{c}": _f1(precision[c], recall[c]) for c in (0, 1)},
        "support0": n00 + n01, "support1": n11 + n10,
        "accuracy": _share(n00 + n11, n00 + n01 + n10 + n11),
    }


def binary_scores(df: DataFrame, label: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """Precision, recall and F1 of class 1, one row."""
    s = _scores()
    return _cells(df, label, prediction).select(
        s["precision1"].alias("precision"), s["recall1"].alias("recall"), s["f11"].alias("f1"))


def classification_report(df: DataFrame, label: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """Per-class scores with support, accuracy, macro and weighted means."""
    base = _cells(df, label, prediction).select(*[v.alias(k) for k, v in _scores().items()])
    c = F.col
    total = c("support0") + c("support1")
    missing = F.lit(None).cast("double")

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"))

    def macro(metric: str) -> Column:
        return (c(f"{metric}0") + c(f"{metric}1")) / 2

    def weighted(metric: str) -> Column:
        return _share(c(f"{metric}0") * c("support0") + c(f"{metric}1") * c("support1"), total)

    metrics = ["precision", "recall", "f1"]
    rows = [
        *[row(str(k), *[c(f"{m}{k}") for m in metrics], c(f"support{k}")) for k in (0, 1)],
        row("accuracy", missing, missing, c("accuracy"), total),
        row("macro avg", *[macro(m) for m in metrics], total),
        row("weighted avg", *[weighted(m) for m in metrics], total),
    ]
    return base.select(F.inline(F.array(*rows)))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; a hot score is combined map-side."""
    s = F.col(score).cast("double")
    return (
        df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())
        .groupBy(s.alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))


def _ranked(df: DataFrame, label: str, score: str, rows_per_cell: int) -> DataFrame:
    grouped = _by_score(df, label, score)
    ranked = running_totals(grouped, "score", ["pos", "neg"], rows_per_cell)
    totals = grouped.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    # One row of totals; a scalar subquery keeps it out of the join planning.
    return ranked.withColumns({
        "all_pos": totals.select("p").scalar(), "all_neg": totals.select("n").scalar()})


def roc_curve(
    df: DataFrame, label: str = "y_true", score: str = "y_score",
    drop_intermediate: bool = True, rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """False and true positive rate per threshold, from (0, 0) at an infinite threshold.

    ``drop_intermediate`` leaves out the points inside a straight piece of the curve.
    """
    rows = _ranked(df, label, score, rows_per_cell)
    if drop_intermediate:
        turns = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        rows = rows.filter(F.col("is_first") | F.col("is_last") | turns)
    points = rows.select(
        F.col("score").alias("threshold"),
        (F.col("cum_neg") / F.nullif("all_neg", F.lit(0))).alias("fpr"),
        (F.col("cum_pos") / F.nullif("all_pos", F.lit(0))).alias("tpr"))
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def roc_auc(
    df: DataFrame, label: str = "y_true", score: str = "y_score", rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Area under the ROC curve by trapezoids; NULL if a class is missing."""
    rows = _ranked(df, label, score, rows_per_cell)
    area = F.sum(F.col("neg") * (2.0 * F.col("cum_pos") - F.col("pos")))
    both = 2.0 * F.max("all_pos") * F.max("all_neg")
    return rows.agg((area / F.nullif(both, F.lit(0.0))).alias("auc"))


def pr_curve(
    df: DataFrame, label: str = "y_true", score: str = "y_score", rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Precision and recall per threshold, closed by the point (recall 0, precision 1)."""
    rows = _ranked(df, label, score, rows_per_cell)
    points = rows.select(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.when(F.col("all_pos") == 0, 1.0)
        .otherwise(F.col("cum_pos") / F.nullif("all_pos", F.lit(0))).alias("recall"))
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def average_precision(
    df: DataFrame, label: str = "y_true", score: str = "y_score", rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Sum of precision times the step in recall."""
    rows = _ranked(df, label, score, rows_per_cell)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    total = F.max("all_pos")
    return rows.agg(
        F.when(total == 0, 0.0).otherwise(F.sum(step) / F.nullif(total, F.lit(0)))
        .alias("average_precision"))


def hard_vote(df: DataFrame, votes: list[str], out: str = "vote") -> DataFrame:
    """Majority of 0/1 predictions; a tie goes to the lower class."""
    ones = sum((F.col(v).cast("int") for v in votes), F.lit(0))
    return df.withColumn(out, (2 * ones > len(votes)).cast("int"))
