"""Spelling variants against comparing all words with each other."""

import random
import re
import zlib
from collections import Counter

import pytest

from ebbtide.llm.queries import op11_spelling
from ebbtide.llm.spelling import follow, near_pairs, spelling_variants


def plain_words(rows, least=5, count=3, mute=97):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % mute == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def plain_neighbours(words):
    """Near words through the words with one code point left out: an index of its own kind."""
    by_rest = {}
    for w in words:
        for rest in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            by_rest.setdefault(rest, []).append(w)
    near = {w: set() for w in words}
    for w in words:
        for rest in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            near[w].update(v for v in by_rest[rest] if one_edit(v, w))
    return near


def plain(rows, **sizes):
    n = plain_words(rows, **sizes)
    near, form = plain_neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def test_one_edit_of_the_test_itself():
    assert one_edit("abcde", "abde") and one_edit("abcde", "abXde") and one_edit("aab", "ab")
    assert not one_edit("abc", "abc") and not one_edit("abc", "acb") and not one_edit("abc", "abcde")


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 6, 7, 11])
def test_all_pairs_of_few_letters(spark, length):
    """Few letters and repeated ones: many keys of a pair agree, each pair still comes up once."""
    draw = random.Random(length)
    words = {"".join(draw.choice("abÿ") for _ in range(draw.choice([length, length + 1]))) for _ in range(60)}
    words = sorted(words)
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted(tuple(sorted((r.x, r.y))) for r in near_pairs(frame).collect())
    assert got == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1:] if one_edit(a, b))


def test_long_words(spark):
    base = "".join(random.Random(1).choice("abcdefgh") for _ in range(3000))
    words = [base, base + "x", "x" + base, base[:1500] + "x" + base[1501:], base[1:], base[:700] + base[702:]]
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {frozenset((r.x, r.y)) for r in near_pairs(frame).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_chains(spark):
    edges = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("v", "w5"), ("u", "t")]
    got = {r.word: r.root for r in follow(spark.createDataFrame(edges, "word string, form string")).collect()}
    assert got == {f"w{i}": "w37" for i in range(37)} | {"v": "w37", "u": "t"}
    assert follow(spark.createDataFrame([], "word string, form string")).count() == 0


def test_edges(make_docs):
    rows = [(1, None), (2, ""), (3, "12 !? ÷×÷×÷ x"), (None, "house house House HOUSE hous"), (4, "houses houses houses"), (4, "houses houses houses"),
            (5, "Élan élan Élans élans élans élans"), (6, "horse " * 9 + "hoarse " * 3 + "hause " * 4), (7, "a" * 70000 + " " + "ab" * 35000),
            (8, "naïve naïve naïve naive naive naive naives naives naives")]
    docs = make_docs(rows, extra=["word", "n", "form", "root"])
    for mute in (97, 3):
        assert rows_of(spelling_variants(docs, mute=mute)) == plain([r[:2] for r in rows], mute=mute)
    assert rows_of(spelling_variants(docs, least_length=1, least_count=1)) == plain([r[:2] for r in rows], least=1, count=1)
    assert spelling_variants(make_docs([])).count() == 0


def test_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op11_spelling(spark, sf_dir)) == plain(rows)
