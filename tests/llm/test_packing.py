"""Packing against the tokenizer and against best fit over single documents."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm.encoder import Encoder
from ebbtide.llm.packing import pack, plan_slots, sequences
from ebbtide.llm.queries import op12_packing
from ebbtide.llm.words import IdTable

ODD = ["", " ", "   a  b ", "a\n b\t c \n", "x <|endoftext|> y", "it's, we'll. don't", "  a  b", "é, ñ. ß,.", None,
       "a" * 3000, " " * 500 + "b", "日本語 テキスト, です。 12,3 4.", "a\x1c b\x85 c", "end.\n\nNext, line  \n x",
       "b " + "w" * 300 + " c", "x\n y", "word.\nNext$$ a×b"]


@pytest.fixture(scope="module")
def plain(tokenizer):
    t = Tokenizer.from_file(tokenizer)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def best_fit(lengths, limit):
    """Number of sequences of best fit decreasing, one piece after the other."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(limit - n)
    return len(rooms)


def lay_out(histogram, limit):
    """Sequences of a plan, each the list of (offset, length)."""
    out, ranks = defaultdict(list), Counter()
    for length, low, high, per, sequence, offset in plan_slots(histogram, limit):
        assert low == ranks[length]
        ranks[length] = high
        for r in range(high - low):
            out[sequence + r // per].append((offset + r % per * length, length))
    assert ranks == Counter(histogram)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 41, 64]))
def test_plan_is_best_fit(lengths, limit):
    laid = lay_out(dict(Counter(lengths)), limit)
    assert len(laid) == best_fit(lengths, limit) and sorted(laid) == list(range(len(laid)))
    for places in laid.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= limit


def test_plan_size_does_not_follow_the_counts():
    draw = random.Random(4)
    histogram = {n: draw.randint(1, 50) for n in range(1, 1025)}
    rows = [len(plan_slots({n: c * factor for n, c in histogram.items()})) for factor in (1, 1000, 10**9)]
    assert max(rows) < 40_000
    with pytest.raises(ValueError):
        plan_slots({1025: 1})


def check(rows, packed, plain, limit):
    got = packed.collect()
    want = Counter()
    for d, t in rows:
        ids = [*plain(t), 2]
        first = len(ids) % limit or limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    laid = defaultdict(list)
    for r in got:
        laid[r.sequence_id].append((r.offset, r.length))
    for places in laid.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= limit
    assert len(laid) == best_fit([r.length for r in got], limit)
    return laid


@pytest.mark.parametrize("limit", [1024, 7, 1])
def test_odd_documents(make_docs, tokenizer, plain, limit):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a b"), (3, "a b"), (7, "word, " * 9000)]
    docs = make_docs(rows, extra=["ids", "length", "rank"])
    packed = pack(docs, tokenizer, limit)
    check(rows, packed, plain, limit)
    assert pack(make_docs([]), tokenizer).count() == 0


def test_sequences_hold_the_ids(make_docs, tokenizer, plain):
    rows = [(i, "some words of text " * (i % 9)) for i in range(60)]
    packed = pack(make_docs(rows), tokenizer, 64)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in sequences(packed).collect()}
    for r in packed.collect():
        ids = [*plain(rows[r.doc_id][1]), 2]
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == ids[r.start:r.start + r.length]


def test_given_documents(spark, sf_dir, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    packed = op12_packing(spark, sf_dir)
    laid = check(rows, packed, plain, 1024)
    total = sum(n for places in laid.values() for _, n in places)
    assert len(laid) <= 1.05 * -(-total // 1024) + 1


def test_word_table_is_exact_and_bounded(tokenizer, plain):
    draw = random.Random(5)
    alphabet = list("abcÉñß×÷.,!$<>|'\n\t  　日1_`~-sd")
    texts = ODD + ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    for kept in (1, 1 << 24):
        table = IdTable(Encoder(tokenizer), kept)
        for start in range(0, len(texts), 700):
            part = texts[start:start + 700]
            ids, ends = table.encode(pa.array(part, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [plain(t) for t in part]
            assert kept > 1 or len(table.known) <= len({w for t in part for w in (t or "").split(" ")})
