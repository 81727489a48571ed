"""Suffix sorting against sorted slices; removed bytes against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import blobs, suffix_dedup
from ebbtide.llm.suffix_dedup import anchor_runs, remove_repeats, repeated_starts, suffix_ranks, without_repeats


def plain(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    often = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if often[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        out.append(str((d, len(t), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def result(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a"])
def test_ranks_order_all_suffixes(letters):
    draw = random.Random(letters)
    for n in [1, 2, 3, 4, 5, 6, 7, 10, 50, 333]:
        text = "".join(draw.choice(letters) for _ in range(n))
        ranks = suffix_ranks(np.array([ord(c) for c in text]), n)
        assert np.argsort(ranks, kind="stable").tolist() == sorted(range(n), key=lambda i: text[i:])
        for depth in (2, 3, 4, 9, 10, 27):
            ranks = suffix_ranks(np.array([ord(c) for c in text]), depth)
            order = np.argsort(ranks, kind="stable")
            prefixes = [text[i:i + depth] for i in order]
            assert prefixes == sorted(prefixes)


def test_repeated_starts_of_pieces():
    draw = random.Random(8)
    base = bytes(draw.choice(b"xyz") for _ in range(300))
    pieces = [base[a:a + 60] for a in (0, 5, 9, 100, 150)] + [base[2:62], b"q" * 60, b"\0" * 60]
    copies, windows = [1, 1, 1, 1, 2, 1, 1, 1], [41] * 8
    often = Counter()
    for p, c in zip(pieces, copies):
        for i in range(41):
            often[p[i:i + 20]] += c
    for p, flags in zip(pieces, repeated_starts(pieces, windows, copies, 20)):
        assert flags.tolist() == [often[p[i:i + 20]] > 1 for i in range(41)]


def test_anchors_follow_content():
    draw = random.Random(9)
    body = bytes(draw.randrange(256) for _ in range(3000))
    anchors, first, count, _ = anchor_runs([b"short", body, b"", b"y" * 400])
    assert count.sum() == 3000 - 199 + 201 and (first >= 5).all()
    again, at, _, _ = anchor_runs([b"zz" + body[500:1500]])
    inner = {a: p - 5 for a, p in zip(anchors.tolist(), first.tolist())}
    same = [inner[a] - (p - 2 + 500) for a, p in zip(again.tolist(), at.tolist()) if a in inner]
    assert len(same) >= len(again) - 2 and same.count(0) >= len(same) - 2


def test_anchors_at_high_places():
    draw = np.random.default_rng(10)
    passage = draw.integers(0, 256, 20_000, np.uint8).tobytes()
    filler = draw.integers(0, 256, (1 << 24) + 5000, np.uint8).tobytes()
    # From below 2**24, across it, and at places with bit 24 set.
    text = passage + filler[:(1 << 24) - 30_000] + passage + filler[(1 << 24) - 30_000:] + passage
    starts = [0, len(passage) + (1 << 24) - 30_000, len(text) - len(passage)]
    anchors, first, count, place = anchor_runs([text])
    assert count.sum() == len(text) - 199 and ((place >= first) & (place <= first + 152)).all()
    runs = [{(a, p - s, n, q - s) for a, p, n, q in zip(anchors.tolist(), first.tolist(), count.tolist(), place.tolist())
             if s + 200 <= p and p + n + 399 <= s + len(passage)} for s in starts]
    assert len(runs[0]) > 100 and runs[0] == runs[1] == runs[2]


def test_repeats_beyond_16_mib(make_docs):
    draw = random.Random(11)
    passage = "".join(draw.choice("abcdefgh") for _ in range(2000))
    filler = np.random.default_rng(12).integers(97, 123, (1 << 24) + 1000, np.uint8).tobytes().decode()
    rows = [(1, filler + passage + "Z" * 150), (2, "Q" * 150 + passage)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(make_docs(rows)).drop("kept").collect()}
    assert got == {1: (len(filler) + 2150, 2000, 1), 2: (2150, 2000, 1)}


@pytest.mark.parametrize("d", [None, 7])
def test_rows_with_one_key_are_told_apart(make_docs, d):
    import xxhash

    draw = random.Random(13)
    passage, clean = ("".join(draw.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    # Of many texts of one length some agree in the 16 bits of any short check.
    bits = xxhash.xxh32_intdigest((passage + "0000000").encode()) & 0xFFFF
    other = next(t for i in range(10**7) if xxhash.xxh32_intdigest((t := f"{clean}{i:07d}").encode()) & 0xFFFF == bits)
    rows = [(d, passage + "0000000"), (1, passage), (d, other)]
    rows += [(d, "".join(draw.choice("stuvwxyz") for _ in range(307))) for _ in range(300)]
    docs = make_docs(rows)
    assert result(remove_repeats(docs)) == plain(rows)
    assert [r.text for r in without_repeats(docs).collect()].count(other) == 1


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(remove_repeats(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("common", [1024, 2])
def test_edges(make_docs, monkeypatch, small, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    if small:
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)
        monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 900)
        monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 500)
        monkeypatch.setattr(blobs, "FILTER_BITS", 1 << 12)
    draw = random.Random(3)
    prose = "".join(draw.choice("abcdefgh é") for _ in range(3000))
    rows = [(1, None), (2, ""), (3, "short"), (4, "z" * 199), (5, "y" * 200), (6, "x" * 201), (7, "ab" * 400), (8, "é" * 150)]
    for d in range(10, 40):
        a, b = sorted(draw.sample(range(3000), 2))
        own = "".join(draw.choice("pqrst") for _ in range(draw.randint(0, 300)))
        rows.append((d, own + prose[a:min(b, a + 700)] + own[:100]))
    rows += [(50, prose[:350]), (50, prose[:350]), (None, prose[900:1300]), (None, prose[900:1300]), (None, "n" + prose[2000:2300])]
    docs = make_docs(rows, extra=["spans", "_found", "_key", "n"])
    assert result(remove_repeats(docs)) == plain(rows)
    kept = without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    one = {r.doc_id: r for r in kept.collect()}
    assert one[1].text is None and one[3].text == "short" and one[7].text == "" and one[7].n_chars == 0
    assert remove_repeats(make_docs([])).count() == 0 and without_repeats(make_docs([])).count() == 0
