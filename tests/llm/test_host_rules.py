"""Base rules against plain loops; the prior and the verdict."""

import re
from collections import Counter

import pytest

from ebbtide.llm.host_rules import Rules, apply_rules, beta_prior, keep_good, text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " \n\t", "a b c a b c d", "a a a a a", "x\n\nx\n x\nx\n", "é ñ ß #*$%&|<> \x1c z", "one", "a b a b a b c " * 30,
       "line one\nline two\nline one\n\n\nline one\r\nline one\r"]


def plain(text):
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


@pytest.mark.parametrize("text", ODD)
def test_counts(text):
    assert text_counts(text.encode()) == plain(text)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in apply_rules(docs).collect()}
    for d in docs.collect():
        want, r = plain(d.text), got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if r.base_failed:
            assert not r.kept


def test_bad_host_is_rejected_and_small_hosts_are_shrunk(make_docs):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "en", f"h{i % 10}") for i in range(200)]
    rows += [(1000 + i, bad, "en", "spam") for i in range(40)] + [(2000, good, "en", "spam")]
    rows += [(3000, bad, "en", "tiny"), (3001, good, "en", None), (3002, None, "en", None)]
    out = {r.doc_id: r for r in apply_rules(make_docs(rows, extra=["kept", "host", "n_words"])).collect()}
    assert not out[2000].kept and out[2000].host_failed and not out[2000].base_failed
    assert out[0].kept and out[3001].kept and not out[3002].kept
    assert 0 < out[3000].host_rate < 1 and out[3000].host_rate < out[2000].host_rate


def test_edges(make_docs, spark):
    assert apply_rules(make_docs([])).count() == 0
    same = " ".join(f"w{i}" for i in range(60))
    out = apply_rules(make_docs([(1, same), (1, same), (None, same)])).collect()
    assert len(out) == 3 and all(r.kept for r in out)
    a, b = beta_prior(spark.createDataFrame([("x", 10, 1), ("y", 10, 1)], "host string, n long, fails long"))
    assert abs((a + b) - 20) < 1e-9
    assert Rules().max_host_rate == 0.5


def test_nulls_long_texts_and_clashing_columns(make_docs):
    good = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"w{i % 90_000}#" for i in range(150_000)) + "\nsame line\nsame line"
    rows = [(1, good), (2, None), (3, ""), (4, " \t\n"), (5, long), (None, good), (6, good, "en", None), (1, good)]
    clashes = ["kept", "host", "n_words", "host_rate", "base_failed", "_row", "_text", "_own", "_good", "_host"]
    docs = make_docs(rows, extra=clashes)
    rules = Rules(max_host_rate=1.0)
    out = sorted(((r.doc_id or 0, r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in apply_rules(docs, rules).collect()))
    want = []
    for row in rows:
        n_words, _, symbols, dup, repeat = plain(row[1] or "")
        bad = n_words < 50 or 100 * repeat > 50 * n_words
        want.append((row[0] or 0, n_words, symbols, dup, repeat, not bad))
    assert out == sorted(want)
    kept = keep_good(docs, rules)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted(
        (row[0] or 0, row[1]) for row, w in zip(rows, want) if w[5])
    assert {r.kept for r in kept.collect()} == {"clash"}
    assert keep_good(make_docs([])).count() == 0
