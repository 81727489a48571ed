"""Chunk reuse against the tokenizer itself."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm import bpe
from ebbtide.llm.bpe import Decoder, chunk_ends, chunks_of, dictionary, digest, encode_decode, id_width, make_entry, recast, splice
from ebbtide.llm.encoder import Encoder


@pytest.fixture(scope="module")
def encoder(tokenizer):
    return Encoder(tokenizer)


@pytest.fixture(scope="module")
def plain(tokenizer):
    t = Tokenizer.from_file(tokenizer)

    def run(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    return run


def prose(draw, n):
    return "".join(draw.choice(["alpha ", "beta, ", "\n\n", "  ", "gamma", "ñé", "x" * 9, ". ", "日本 "]) for _ in range(n))


def test_chunks_are_content_defined():
    draw = random.Random(2)
    body = prose(draw, 4000).encode()
    first, second = (chunks_of(t, chunk_ends([t])[0]) for t in (body, b"a different start. " + body))
    assert b"".join(first) == body and len(first) > 5
    assert len(set(first) & set(second)) > len(first) // 2
    assert all(len(c) <= bpe.MOST_CHUNK for c in first) and [c.decode() for c in first]
    together = chunk_ends([b"some other text before", b"", body])
    assert together[2] == chunk_ends([body])[0] and together[1] == []
    assert sum(map(len, chunks_of(b"y" * 9000, chunk_ends([b"y" * 9000])[0]))) == 9000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é,.'s\n\t  　日1<|>", max_size=15), max_size=6))
def test_splice_of_any_cuts(encoder, texts):
    whole = encoder.direct(["".join(texts)])[0]
    assert splice(encoder, texts, [make_entry(encoder, t) for t in texts]) == whole


def test_wrong_entry_is_noticed_at_the_join(encoder):
    texts = ["one two three four", " five six seven eight"]
    entries = [make_entry(encoder, t) for t in texts]
    entries[1].ids = b"\1\0\0\0" + entries[1].ids[4:]
    assert splice(encoder, texts, entries) == encoder.direct(["".join(texts)])[0]


def test_dictionary_holds_two_bytes_an_id_where_they_suffice(spark, tokenizer, encoder):
    texts = ["one two three four five six", "naïve 日本 \x7f and more words here"]
    chunks = spark.createDataFrame([(digest(t.encode()), t.encode()) for t in texts], "home binary, body binary")
    got = {bytes(r.key): bytes(r.ids) for r in dictionary(chunks, tokenizer).collect()}
    for t in texts:
        whole = make_entry(encoder, t).ids
        assert len(got[digest(t.encode())]) == len(whole) // 2 and recast(got[digest(t.encode())], "<u2", "<u4") == whole
    large = SimpleNamespace(tokenizer=SimpleNamespace(get_vocab=lambda with_added_tokens: {"a": 0, "b": 1 << 16}))
    assert id_width(large) == "<u4" and recast(b"\0\0\1\0", "<u4", "<u4") == b"\0\0\1\0"


def test_decoder(encoder):
    for t in ["", "naïve <|endoftext|> 日本\x00\x7f\xad", prose(random.Random(1), 300)]:
        ids = encoder.direct([t])[0]
        assert Decoder(encoder).text(ids) == encoder.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == t


def test_given_documents(spark, sf_dir, tokenizer, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in encode_decode(docs, tokenizer).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}


@pytest.mark.parametrize("bucket_bytes", [4_000_000, 500])
def test_edges(make_docs, tokenizer, plain, monkeypatch, bucket_bytes):
    monkeypatch.setattr(bpe, "BUCKET_BYTES", bucket_bytes)
    draw = random.Random(7)
    body = prose(draw, 800)
    rows = [(1, None), (2, ""), (3, body), (3, body), (4, "new start " + body), (5, body + "z"), (None, body), (6, "z" * 30000),
            (7, "z" * 30000), (8, "<|endoftext|> a"), (9, body[:900] + "changed" + body[900:])]
    got = [tuple(r) for r in encode_decode(make_docs(rows, extra=["home", "keys", "n_tokens"]), tokenizer).collect()]
    assert sorted(map(str, got)) == sorted(str((d, *plain(t))) for d, t in rows)
    assert encode_decode(make_docs([]), tokenizer).count() == 0
