"""Alignment against both libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm.alignment import (
    SPOILT, AlignedWords, Fragment, Tokenizers, align_texts, align_tokenizers, compose, finish, fragment, ranges,
)
from ebbtide.llm.queries import op13_alignment

ODD = ["", " ", "   a  b ", "a\n b\t c \n", "x <|endoftext|> y </s> <s>", "it's, we'll. don't", "  a  b", "é, ñ. ß,.", None,
       "a" * 3000, " " * 500 + "b", "日本語 テキスト, です。 12,3 4.", "a\x1c b\x85 c", "end.\n\nNext, line  \n x", "a▁b", "fine ▁ bad",
       "b " + "w" * 300 + " c", "x\n y", "word.\nNext$$ a×b", "﻿ﬁ ② 🙂 zero​width", "x\x00y z", "tail "]


@pytest.fixture(scope="module")
def paths(tokenizer):
    return tokenizer, public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair(paths):
    return Tokenizers(*paths)


@pytest.fixture(scope="module")
def plain(paths):
    """(a ids, b ids, groups as lists) of a text from the libraries alone; None without tokens."""
    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    unmap = {c: n for n, c in _byte_level().items()}
    entry = {i: bytes(unmap[c] for c in t) for t, i in a.get_vocab().items()}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def run(text):
        if not text:
            return None
        content = b" " + text.encode()
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(entry[i] for i in x) != content or b"".join(map(piece, y)) != content:
            return None
        ends_x, ends_y, at = {}, {}, 0
        for n, i in enumerate(x):
            at += len(entry[i])
            ends_x[at] = n + 1
        at = 0
        for n, i in enumerate(y):
            at += len(piece(i))
            ends_y[at] = n + 1
        groups, p, q = [], 0, 0
        for at in sorted(set(ends_x) & set(ends_y)):
            groups.append((x[p:ends_x[at]], y[q:ends_y[at]]))
            p, q = ends_x[at], ends_y[at]
        return x, y, groups

    return run


def _byte_level():
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {}, 0
    for n in range(256):
        out[n] = chr(n) if n in shown else chr(256 + extra)
        extra += n not in shown
    return out


def text_of(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def expected(rows, plain):
    done = [(d, plain(t)) for d, t in rows]
    counts = Counter((x[-1], y[-1]) for _, r in done if r for x, y in r[2])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for d, r in done:
        if r is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in r[2]]
        out.append((d, len(r[0]), len(r[1]), len(r[2]), len(links), sum(counts[p] == highest[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text_of(r[2]).encode()).hexdigest()))
    return sorted(map(str, out))


def check(rows, frame, plain):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in frame.select(*columns).collect()) == expected(rows, plain)


def test_pairs_hold_every_possible_link(pair):
    draw, n = random.Random(2), len(pair.b_bytes)
    assert len(pair.pairs) <= sum(map(len, pair.a_bytes)) + sum(map(len, pair.b_bytes))
    known = set(pair.pairs.tolist())
    for _ in range(20_000):
        a, b = draw.randrange(len(pair.a_bytes)), draw.randrange(n)
        x, y = pair.a_bytes[a], pair.b_bytes[b]
        assert (x.endswith(y) or y.endswith(x)) == (a * n + b in known)


def long_text(draw, words=4000):
    parts = ["alpha ", "beta, ", "\n\n", "  ", "gamma", "é" * 40, "日本語テキスト", ". ", "unhappiness ", "internationalization ", "🙂"]
    return "".join(draw.choice(parts) for _ in range(words))


@pytest.mark.parametrize("shared", [0, 8, 4096])
def test_fragments_of_any_tree(pair, plain, shared):
    draw = random.Random(shared)
    text = long_text(draw, 600)
    x, y, groups = plain(text)
    table = AlignedWords(pair)
    for size in (1, 5, 64, 1000):
        done = []
        parts = ranges(text.encode(), size, shared)
        for (a, b, good), (_, low, high) in zip(table.tokens([p[0].decode() for p in parts]), parts):
            assert good
            done.append(fragment(pair, a, b, low, high))
        while len(done) > 1:  # compose neighbours in any order
            k = draw.randrange(len(done) - 1)
            done[k:k + 2] = [compose(done[k], done[k + 1])]
        n_a, n_b, n_groups, links, digest = finish(done[0])
        assert (n_a, n_b, n_groups) == (len(x), len(y), len(groups))
        assert digest == hashlib.sha256(text_of(groups).encode()).hexdigest()
        assert [pair.pairs[i] for i in np.frombuffer(links, "<i4")] == [p[-1] * len(pair.b_bytes) + q[-1] for p, q in groups]


def test_identity_and_absorbing(pair):
    f = fragment(pair, np.array([1, 2], np.uint32), np.array([5], np.uint32), 0, 2)
    assert compose(f, Fragment()) == f == compose(Fragment(), f)
    assert compose(f, SPOILT) == SPOILT == compose(SPOILT, f) and finish(SPOILT) == (0, 0, 0, b"", "")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é,.'s\n\t  　日1<|>▁", max_size=60))
def test_any_text(pair, plain, text):
    (got,) = align_texts(AlignedWords(pair), pa.array([text]))
    want = plain(text)
    assert got[:3] == ((len(want[0]), len(want[1]), len(want[2])) if want else (0, 0, 0))
    assert got[4] == (hashlib.sha256(text_of(want[2]).encode()).hexdigest() if want else "")


def test_small_memory_starts_anew_but_stays_exact(pair, plain):
    table = AlignedWords(pair, kept=1)
    for i in range(20):
        text = " ".join(f"w{i}{j}," for j in range(9))
        assert align_texts(table, pa.array([text]))[0][0] == len(plain(text)[0])


@pytest.mark.parametrize("size", [32 << 10, 50])
def test_odd_documents(make_docs, paths, plain, size):
    draw = random.Random(8)
    long = long_text(draw, 1500)
    rows = [(i, t) for i, t in enumerate(ODD)] + [
        (None, "a b"), (3, "a b"), (3, "a b"), (7, long), (7, long), (None, long), (90, long + "▁"), (91, "y" * 9000), (92, long + " ")]
    frame = align_tokenizers(make_docs(rows, extra=["n_a", "links", "number"]), *paths, size=size, fan_in=3)
    check(rows, frame, plain)
    assert align_tokenizers(make_docs([]), *paths).count() == 0


def test_given_documents(spark, sf_dir, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, op13_alignment(spark, sf_dir), plain)
