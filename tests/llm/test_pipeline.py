"""The pipeline against plain versions of its stages."""

from statistics import mean, variance

import test_bpe
import test_decontaminate
import test_host_rules
import test_simhash
import test_suffix_dedup
from test_bpe import plain as plain_bpe  # noqa: F401  (a fixture)

import corpus_pipeline
from ebbtide.llm.queries import QUERIES


def host_verdicts(rows, bad):
    hosts = {}
    for r in rows:
        hosts.setdefault(r["source"], []).append(bad[id(r)])
    n = sum(map(len, hosts.values()))
    m = (sum(map(sum, hosts.values())) + 0.5) / (n + 1)
    rates = [mean(map(float, h)) for h in hosts.values()]
    spread = variance(rates) if len(rates) > 1 else 0.0
    own = spread - m * (1 - m) * mean(1 / len(h) for h in hosts.values())
    weight = min(max((m * (1 - m) - spread) / own, 1.0) if own > 0 else n, n)
    return {k: (sum(h) + m * weight) / (len(h) + weight) > 0.5 for k, h in hosts.items()}


def removed_text(text, often, length=200):
    t = text.encode()
    gone = bytearray(len(t))
    for i in range(len(t) - length + 1):
        if often[t[i:i + length]] > 1:
            gone[i:i + length] = b"\1" * length
    return bytes(c for c, g in zip(t, gone) if not g).decode(errors="ignore")


def plain_pipeline(docs, items):
    bad = {}
    for r in docs:
        n, _, _, _, repeated = test_host_rules.plain(r["text"] or "")
        bad[id(r)] = n < 50 or 100 * repeated > 50 * n
    verdict = host_verdicts(docs, bad) if docs else {}
    docs = [r for r in docs if not bad[id(r)] and not verdict[r["source"]]]
    fps = [(r["doc_id"], test_simhash.plain(r["text"])) for r in docs]
    docs = [r for r, root in zip(docs, test_simhash.roots(fps)) if r["doc_id"] is None or r["doc_id"] == root]
    often = test_suffix_dedup.Counter(t[i:i + 200] for t in (r["text"].encode() for r in docs) for i in range(len(t) - 199))
    docs = [r | {"text": removed_text(r["text"], often)} for r in docs]
    clean = {r[0] for r in test_decontaminate.plain([(k, r["text"]) for k, r in enumerate(docs)], items) if not r[5]}
    return [r for k, r in enumerate(docs) if str(k) in clean]


def test_given_tables(spark, sf_dir, plain_bpe):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = sorted((r["doc_id"], *plain_bpe(r["text"])) for r in plain_pipeline(docs, items))
    assert 0 < len(want) < len(docs)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want


def test_stages_keep_the_columns(make_docs, spark, sf_dir):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, good + " more"), (None, good), (5, "a b " * 90), (6, " ".join(f"v{i}" for i in range(80)), None, None)]
    for docs in (make_docs(rows, extra=["kept", "spans"]), make_docs([])):
        frame = docs
        for name, function in corpus_pipeline.STAGES[:-1]:
            frame = function(spark, frame, sf_dir)
            assert frame.columns == docs.columns, name
            assert [f.dataType for f in frame.schema] == [f.dataType for f in docs.schema], name
        last = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir)
        ids = sorted(str(r.doc_id) for r in last.collect())
        assert ids == (["3", "3", "6", "None"] if docs.columns != make_docs([]).columns else [])


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 11))
    assert test_bpe.bpe
