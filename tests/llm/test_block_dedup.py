"""Removed words against a table of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from ebbtide.llm import blobs, block_dedup
from ebbtide.llm.blobs import pack, pack_signed, pack_sorted, unpack, unpack_signed, unpack_sorted
from ebbtide.llm.block_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rows_with_one_id_are_told_apart(make_docs):
    import xxhash

    draw = random.Random(14)
    passage, clean = (" ".join(f"{c}{draw.randrange(10**6)}" for _ in range(20)) for c in "pc")
    bits = xxhash.xxh32_intdigest((passage + " 0000000").encode()) & 0xFFFF
    other = next(t for i in range(10**7) if xxhash.xxh32_intdigest((t := f"{clean} {i:07d}").encode()) & 0xFFFF == bits)
    rows = [(7, passage + " 0000000"), (1, passage), (7, other), (7, passage + " 0000000")]
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in remove_repeats(make_docs(rows)).collect())
    assert got == [(1, 0, passage), (7, 0, other), (7, 20, "0000000"), (7, 20, "0000000")]


def plain(rows):
    least, out = {}, []
    for d, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - 12 if d is not None else 0):
            key = tuple(w[i:i + 13])
            least[key] = min(d, least.get(key, d))
    for d, text in rows:
        w = WORD.findall(text or "")
        gone = {i + k for i in range(len(w) - 12 if d is not None else 0) if least[tuple(w[i:i + 13])] < d for k in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append(str((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)))
    return sorted(out)


def result(df):
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text)) for r in df.collect())


def test_packing():
    draw = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([0, 2**64 - 1, 5], np.uint64), draw.integers(0, 2**40, 1000).astype(np.uint64)):
        assert (unpack(pack(values)) == values).all()
        assert (unpack_sorted(pack_sorted(np.sort(values))) == np.sort(values)).all()
    signed = np.array([-5, 7, -2**62, 2**62, 0])
    assert (unpack_signed(pack_signed(signed)) == signed).all()


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert result(remove_repeats(docs)) == want


@pytest.mark.parametrize("slice_bytes", [8_000_000, 300])
def test_edges(make_docs, monkeypatch, slice_bytes):
    monkeypatch.setattr(block_dedup, "SLICE_BYTES", slice_bytes)
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    rows = [(1, None), (2, ""), (3, "few words"), (None, " ".join(passage)), (None, " ".join(passage)), (-7, "x " * 300)]
    for d in range(10, 40):
        a, b = sorted(draw.sample(range(41), 2))
        filler = [f"{d}_{i}" for i in range(draw.randint(0, 20))]
        rows.append((d, "\t".join(filler + passage[a:b] + ["é\x1cz", *filler[:5]])))
    rows += [(50, "x " * 13), (51, "x " * 12), (52, " ".join(passage)), (52, " ".join(passage)), (52, " ".join(passage[:30]) + " other")]
    rows += [(53, " ".join("ab"[draw.random() < 0.5] for _ in range(400))), (54, " ".join("ab"[draw.random() < 0.5] for _ in range(400)))]
    assert result(remove_repeats(make_docs(rows, extra=["spans", "n", "_id"]))) == plain(rows)
    assert remove_repeats(make_docs([])).count() == 0


def test_full_filter_costs_work_only(make_docs, monkeypatch):
    monkeypatch.setattr(blobs, "FILTER_BITS", 1 << 10)
    draw = random.Random(6)
    base = [draw.choice("abcdefgh") + str(draw.randint(0, 50)) for _ in range(3000)]
    rows = [(d, " ".join(base[d * 20:d * 20 + 400] + [f"u{d}"] * 5)) for d in range(100)]
    assert result(remove_repeats(make_docs(rows))) == plain(rows)
