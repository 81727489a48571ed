"""Hits against a scan of all windows."""

import hashlib
import random
import re

import pytest

from ebbtide.llm.decontaminate import contamination, decontaminate, merge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(str(item) if item is not None else "null")
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i:i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_given_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(r[5] for r in want)
    assert result(contamination(docs, bench)) == want
    assert result(contamination(docs, bench, block_bytes=5000)) == want
    left = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert left == {int(r[0]) for r in want if not r[5]}


@pytest.mark.parametrize("block_bytes", [10**6, 40])
def test_edges(make_docs, spark, block_bytes):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 40)))) for i in range(30)]
    rows += [(50, None), (51, ""), (None, "The quick, brown FOX-jumps!"), (52, "x " * 500), (52, "x " * 500), (53, "çé ñ1 été")]
    items = [(1, "a b a b b a a b a b"), (2, "quick brown"), (3, None), (4, "..."), (None, "Çé ñ1"), (5, "çé ñ1"),
             (6, " ".join("x" * 12)), (2, "a a a a a a a a a a a"), (7, "fox")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS spans", "2 AS _text")
    docs = make_docs(rows, extra=["_row", "items", "n_hit"])
    assert result(contamination(docs, bench, block_bytes=block_bytes)) == plain(rows, items)
    kept = decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in plain(rows, items))
    assert contamination(make_docs([]), bench).count() == 0
    none = contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_longest_match(make_docs, spark):
    passage = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, "start " + passage + " end")], "item_id long, text string")
    out = {r.doc_id: r for r in contamination(make_docs([(1, "before " + passage + " after"), (2, "w1 w2")]), bench).collect()}
    assert out[1].longest == 30 and out[1].spans == [1, 31] and out[2].longest == 0


def test_merge():
    assert merge([5, 9, 1, 3, 3, 4, 8, 12]) == [1, 4, 5, 12]
