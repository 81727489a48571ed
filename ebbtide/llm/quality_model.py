"""Quality scores by a sparse ensemble of rules over text statistics.

A small random forest is fitted to the statistics of labelled texts.  Every path from a root
is a rule: a conjunction of bounds on statistics.  Lasso logistic regression keeps the rules
that matter, and these become one Spark column expression, so scoring is a projection.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import bytes_of, id_type, map_rows, narrow
from ebbtide.llm.host_rules import SYMBOLS, repeat_words
from ebbtide.sources.staging import stage

STATISTICS = ["log_words", "word_chars", "symbol_rate", "upper_rate", "digit_rate", "exclaim_rate", "distinct_rate",
              "top_word_rate", "repeat_rate", "dup_line_rate", "line_words", "stop_rate", "run_rate", "longest_word",
              "wide_rate"]
#: Bound of the labelled sample the forest and the weights are fitted on.
SAMPLE_ROWS = 20_000
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_BOUND = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")

Bounds = tuple[tuple[int, str, float], ...]  # (statistic, "<=" or ">", value), sorted


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 3
    penalty: float = 0.001
    iterations: int = 60
    seed: int = 11


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Bounds, float]] = field(default_factory=list)


def text_statistics(text: bytes) -> list[float]:
    """Statistics of a UTF-8 text; an empty text gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    run = best = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        if run > best:
            best = run
    without = lambda chars: size - len(text.translate(None, chars))
    wide = size - len(text.decode())
    return [math.log1p(n), sum(map(len, words)) / n, without(SYMBOLS) / n, without(_UPPER) / n, without(_DIGITS) / n,
            text.count(b"!") / n, len(counts) / n, max(counts.values()) / n, repeat_words(words) / n,
            (len(lines) - len(set(lines))) / len(lines), n / len(lines), without(b".,") / n, best / n,
            float(max(map(len, counts))), wide / n]


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every row; null texts count as empty."""
    def work(batch):
        rows = [text_statistics(t) for t in bytes_of(batch.column(1))]
        return [batch.column(0), *(np.array([r[k] for r in rows], float).tolist() for k in range(len(STATISTICS)))]

    schema = f"doc_id {id_type(docs)}, " + ", ".join(f"{s} double" for s in STATISTICS)
    return map_rows(narrow(docs, "doc_id", "text"), schema, work)


def paths(debug: str) -> list[Bounds]:
    """All paths from a root to a node, as bounds, in the text form of a tree ensemble."""
    found: set[Bounds] = set()
    open_bounds: list[tuple[int, tuple[int, str, float]]] = []
    for line in debug.splitlines():
        match = _BOUND.search(line)
        if not match:
            continue
        indent = len(line) - len(line.lstrip())
        open_bounds = [b for b in open_bounds if b[0] < indent]
        open_bounds.append((indent, (int(match[2]), match[3], float(match[4]))))
        found.add(simplified([b for _, b in open_bounds]))
    return sorted(found)


def simplified(bounds: list[tuple[int, str, float]]) -> Bounds:
    """One bound per statistic and side: the narrowest."""
    tight: dict[tuple[int, str], float] = {}
    for s, side, value in bounds:
        narrower = min if side == "<=" else max
        tight[s, side] = narrower(value, tight.get((s, side), value))
    return tuple(sorted((s, side, v) for (s, side), v in tight.items()))


def holds(rule: Bounds, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for s, side, v in rule:
        out &= values[:, s] <= v if side == "<=" else values[:, s] > v
    return out


def condition(rule: Bounds) -> str:
    """The rule as SQL."""
    return " AND ".join(f"`{STATISTICS[s]}` {side} CAST('{v!r}' AS DOUBLE)" for s, side, v in rule)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the statistics and the id; all if there are fewer."""
    n = labelled.count()
    if n <= rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64("doc_id", *STATISTICS), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def fit(labelled: DataFrame, settings: Settings = Settings(), rows: int = SAMPLE_ROWS) -> RuleModel:
    """Rules and weights from rows ``(doc_id, statistics, label)`` with label 0 or 1.

    With one class only the score is the smoothed share of ones; with no row it is one half.
    """
    values = F.array(*[F.col(s) for s in STATISTICS])
    train = stage(sample(labelled, rows).select(values.alias("v"), F.col("label").cast("double").alias("label")), "labelled")
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    ones, all_rows = counts.get(1.0, 0), sum(counts.values())
    if len(counts) < 2:
        return RuleModel(math.log((ones + 0.5) / (all_rows - ones + 0.5)))
    train = train.repartition(train.sparkSession.sparkContext.defaultParallelism).persist()
    forest = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, featureSubsetStrategy="onethird",
                                    seed=settings.seed, labelCol="label", featuresCol="x")
    rules = paths(forest.fit(train.select("label", array_to_vector("v").alias("x"))).toDebugString)
    width = len(STATISTICS)

    def evaluate(batch):
        v = batch.column(0).flatten().to_numpy().reshape(-1, width)
        hits = np.stack([holds(r, v) for r in rules], 1).astype(float)
        return [hits.tolist(), batch.column(1)]

    hit = map_rows(train.select("v", "label"), "hits array<double>, label double", evaluate).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=settings.penalty, maxIter=settings.iterations,
                               standardization=False, labelCol="label", featuresCol="x")
    model = lasso.fit(hit.select("label", array_to_vector("hits").alias("x"))) if rules else None
    hit.unpersist()
    train.unpersist()
    if model is None:
        return RuleModel(math.log((ones + 0.5) / (all_rows - ones + 0.5)))
    weights = model.coefficients.toArray()
    return RuleModel(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w != 0])


def score_column(model: RuleModel) -> Column:
    """The compiled ensemble: the logistic function of the sum of the weights of the rules that hold."""
    terms = [f"CASE WHEN {condition(r)} THEN CAST('{w!r}' AS DOUBLE) ELSE 0D END" for r, w in model.rules]
    return F.expr(f"1D / (1D + exp(-({' + '.join([f"CAST('{model.intercept!r}' AS DOUBLE)", *terms])})))")


def score_quality(docs: DataFrame, labels: DataFrame, where: str, cut: float = 0.7,
                  settings: Settings = Settings(), rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, score, predicted`` and the statistics.

    ``where`` (SQL over ``doc_id``) picks the rows whose ``labels.quality`` may be learned.  Labels
    that are null or not 0 or 1 are left out; of several labels of one ``doc_id`` the least counts.
    Null and empty texts are scored on zero statistics, texts of any length on whole ones; repeated
    rows and null ids are kept.  An empty table gives an empty one; without usable labels every
    score is the same.  Other columns are not read, whatever their names.
    """
    frame = stage(statistics(docs), "statistics")
    known = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("label"))
    labelled = frame.where(where).join(known, F.col("doc_id") == F.col("_id")).drop("_id")
    model = fit(labelled, settings, rows)
    scored = frame.withColumn("score", score_column(model))
    return scored.select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"), *STATISTICS)
