"""Encoders against the tokenizer itself."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm.encoder import Encoder, cut_stable
from ebbtide.llm.token_counts import count_tokens, encode_chunked

ODD = ["", " ", "   a  b ", "a\n b\t c \n", "x <|endoftext|> y", "it's, we'll. don't", "  a  b", "é, ñ. ß,.",
       "a" * 3000, " " * 500 + "b", "日本語 テキスト, です。 12,3 4.", "a\x1c b\x85 c", "end.\n\nNext, line  \n x"]


@pytest.fixture(scope="module")
def encoder(tokenizer):
    return Encoder(tokenizer)


@pytest.fixture(scope="module")
def plain(tokenizer):
    t = Tokenizer.from_file(tokenizer)
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_odd_texts(encoder, plain):
    assert encoder.ids_many(ODD) == [plain(t) for t in ODD]
    for t in ODD:
        assert "".join(cut_stable(t)) == t
        assert b"".join(encoder.pieces(t)[1]) == plain(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é,.'s\n\t  　日1<|>", max_size=60))
def test_any_text(encoder, plain, text):
    assert encoder.ids_many([text])[0] == plain(text)
    assert encode_chunked(encoder, text, 8, 2) == plain(text)


def test_small_memory_forgets_but_stays_exact(tokenizer, plain):
    small = Encoder(tokenizer, kept=5)
    texts = [" ".join(f"w{i}{j}," for j in range(9)) for i in range(20)]
    for t in texts:
        assert small.ids_many([t]) == [plain(t)]


def test_chunks_of_long_texts(encoder, plain):
    draw = random.Random(1)
    long = "".join(draw.choice(["alpha ", "beta, ", "\n\n", "  ", "gamma", "x" * 30, ". "]) for _ in range(4000))
    for chunk, overlap in ((1000, 64), (64, 4), (300, 1)):
        assert encode_chunked(encoder, long, chunk, overlap) == plain(long)
    assert encode_chunked(encoder, "y" * 5000, 512, 16) == plain("y" * 5000)


def test_splices_are_where_both_chunks_agree(encoder, plain, monkeypatch):
    from ebbtide.llm import token_counts

    seen, widths, splice = [], [], token_counts._splice

    def watched(text, left, right, start, end):
        met = splice(text, left, right, start, end)
        widths.append(end - start)
        if met:
            place, i, j = met
            assert start < place < end and text[place] == " " and not text[place - 1].isspace()
            assert left[1][i - 1] == right[1][j - 1] == place
            seen.append(place)
        return met

    monkeypatch.setattr(token_counts, "_splice", watched)
    text = ("début, of. the " * 40 + "z" * 700 + " <|endoftext|> 日本 é  x\n\n ") * 5
    assert encode_chunked(encoder, text, 256, 16) == plain(text)
    assert len(seen) > 10 and min(widths) == 16 and max(widths) >= 512  # widened over the long word


def test_chunks_that_disagree_are_not_spliced(encoder, plain, monkeypatch):
    from ebbtide.llm import token_counts

    real = token_counts._encode

    def wrong_near_the_cut(encoder, text, start, end):  # tokens of a chunk's first 40 characters
        ids, ends = real(encoder, text, start, end)
        ids = ids.copy()
        if start:
            ids[ends < start + 40] += 1
        return ids, ends

    monkeypatch.setattr(token_counts, "_encode", wrong_near_the_cut)
    text = "alpha beta, gamma delta. " * 80
    assert encode_chunked(encoder, text, 300, 16) == plain(text)


def test_texts_without_boundaries_cost_in_proportion(encoder, plain, monkeypatch):
    from ebbtide.llm import token_counts

    real, work = token_counts._encode, []
    monkeypatch.setattr(token_counts, "_encode", lambda e, t, a, b: (work.append(b - a), real(e, t, a, b))[1])
    text = "日本語テキスト" * 3000
    assert encode_chunked(encoder, text, 256, 128) == plain(text)
    assert sum(work) < 12 * len(text)


def test_count_tokens(make_docs, tokenizer, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "a b"), (3, "a b"), (3, "a b"), (7, "word, " * 9000)]
    out = count_tokens(make_docs(rows, extra=["n_tokens", "n_bytes"]), tokenizer).collect()
    expected = sorted((str(i), len((t or "").encode()), len(plain(t or "")) // 4, len(plain(t or "")) // 4 > 512) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out) == expected
    assert count_tokens(make_docs([]), tokenizer).count() == 0


def test_given_documents(spark, sf_dir, tokenizer, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, tokenizer).collect()}
    assert got == {r.doc_id: len(plain(r.text)) // 4 for r in docs.collect()}
