"""Rules against the trees they come from; held-out accuracy."""

import math
import re

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from ebbtide.llm.quality_model import (
    STATISTICS, RuleModel, condition, holds, paths, score_column, score_quality, simplified, text_statistics,
)

LEARN = "crc32(cast(doc_id AS string)) % 4 <> 2"


def test_paths_cover_every_tree(spark):
    draw = np.random.default_rng(1)
    x = draw.random((300, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.7)).astype(float)
    frame = spark.createDataFrame([(float(b), Vectors.dense(a.tolist())) for a, b in zip(x, y)], ["label", "x"])
    forest = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1, featuresCol="x", labelCol="label").fit(frame)
    rules = paths(forest.toDebugString)
    assert rules and all(1 <= len(r) <= 6 for r in rules)
    roots = {(int(m[1]), float(m[2])) for m in re.finditer(r"\n    If \(feature (\d+) <= (\S+)\)", forest.toDebugString)}
    assert len(roots) >= 2 and all(((f, side, v),) in rules for f, v in roots for side in ("<=", ">"))
    assert simplified([(1, "<=", 3.0), (1, "<=", 2.0), (0, ">", 1.0), (0, ">", 4.0)]) == ((0, ">", 4.0), (1, "<=", 2.0))


def test_compiled_score_equals_the_sum(spark):
    draw = np.random.default_rng(2)
    v = draw.random((50, len(STATISTICS)))
    rules = [(((0, "<=", 0.5), (3, ">", 0.25)), 1.5), (((2, ">", 0.1),), -2.25), (((5, "<=", float(v[3, 5])),), 0.125)]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in v], STATISTICS)
    got = [r[0] for r in frame.select(score_column(RuleModel(-0.3, rules))).collect()]
    want = 1 / (1 + np.exp(-(-0.3 + sum(w * holds(r, v) for r, w in rules))))
    assert np.allclose(got, want, atol=1e-12)
    assert "AND" in condition(rules[0][0])


def test_statistics_of_odd_texts():
    for t in [b"", b"  \n", b"one", "é Ñ\n\nx x x".encode(), b"a! " * 1000]:
        values = text_statistics(t)
        assert len(values) == len(STATISTICS) and all(math.isfinite(v) for v in values)
    assert text_statistics(b" \n") == [0.0] * len(STATISTICS)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, labels, LEARN).join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 4 = 2").collect()
    right = sum(r.predicted == r.quality for r in out) / len(out)
    base = max(sum(r.quality for r in out), sum(1 - r.quality for r in out)) / len(out)
    assert right > max(0.93, base)


def test_edges(make_docs, spark):
    docs = make_docs([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x y z")], extra=["score", "label", "_id"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = score_quality(docs, none, LEARN).collect()
    assert len(out) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in out)
    some = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (1, None, 0), (2, 7, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    one_class = score_quality(docs, some, "true").collect()
    assert all(0.5 < r.score < 1 for r in one_class)
    assert score_quality(make_docs([]), some, LEARN).count() == 0
