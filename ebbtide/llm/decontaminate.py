"""Benchmark passages in training documents, by suffix arrays of the training words.

Every batch of documents is one shard.  Its suffix array holds the word positions, sorted by
the words that follow; every window of a benchmark item is binary-searched in it, which gives
all verbatim occurrences as one range of the array.  The documents stay where they are: the
benchmark travels to them, in blocks of a fixed greatest size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import narrow, slices

WINDOW = 10
#: Greatest size of the benchmark text that is sent to the tasks at once.
BLOCK_BYTES = 8_000_000
SHARD_ROWS = 1024

#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
                    for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


@dataclass
class Queries:
    """Windows of a block of items, ready for the search."""

    codes: dict[bytes, int]          # word -> 1, 2, ...
    low: list[np.ndarray]            # packed words of each distinct window, padded low
    high: list[np.ndarray]           # the same, padded high
    size: np.ndarray                 # words of each distinct window
    uses: list[list[tuple[int, int]]]  # (item, offset) of each distinct window
    names: list[str]                 # item_id as text
    pairs: np.ndarray | None         # sorted packed first two words; None: some window has one word
    per_key: int                     # words in a 64-bit key
    window: int


def _packed(codes: np.ndarray, per_key: int) -> np.ndarray:
    """For each position, its ``per_key`` words as one ordered 64-bit key."""
    bits = 64 // per_key
    padded = np.concatenate([codes, np.zeros(per_key, codes.dtype)]).astype(np.uint64)
    out = np.zeros(len(codes), np.uint64)
    for k in range(per_key):
        out = (out << np.uint64(bits)) | padded[k:k + len(codes)]
    return out


def prepare(items: list[tuple[str, str | None]], window: int = WINDOW) -> Queries:
    codes: dict[bytes, int] = {}
    names = sorted({str(i) for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for item, text in items:
        ids = [codes.setdefault(w, len(codes) + 1) for w in words_of((text or "").encode())]
        size = min(window, len(ids))
        for s in range(len(ids) - size + 1 if ids else 0):
            found.setdefault(tuple(ids[s:s + size]), []).append((number[str(item)], s))
    per_key = 4 if len(codes) < 65535 else 2
    keys, full = -(-window // per_key), (1 << 64 // per_key) - 1
    bits = 64 // per_key
    low, high = [], []
    for k in range(keys):
        part = [w[k * per_key:(k + 1) * per_key] for w in found]
        for out, pad in ((low, 0), (high, full)):
            out.append(np.array([sum((p[j] if j < len(p) else pad) << bits * (per_key - 1 - j) for j in range(per_key))
                                 for p in part], dtype=np.uint64))
    size = np.array([len(w) for w in found], np.int64)
    pairs = None if (size < 2).any() else np.unique([w[0] << 32 | w[1] for w in found]).astype(np.uint64)
    return Queries(codes, low, high, size, list(found.values()), names, pairs, per_key, window)


def _bound(arrays: list[np.ndarray], key: list[np.ndarray], after: bool) -> np.ndarray:
    """For each query the first rank whose key is not below it (``after``: is above it)."""
    low, high = np.zeros(len(key[0]), np.int64), np.full(len(key[0]), len(arrays[0]), np.int64)
    while (active := low < high).any():
        mid = np.minimum((low + high) // 2, len(arrays[0]) - 1)
        go = np.full(len(mid), after)
        for a, q in zip(reversed(arrays), reversed(key)):
            v = a[mid]
            go = (v < q) | ((v == q) & go)
        low = np.where(active & go, mid + 1, low)
        high = np.where(active & ~go, mid, high)
    return low


def occurrences(texts: list[bytes], q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and per occurrence: text number, word offset and distinct window."""
    lists = [words_of(t) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    get = q.codes.get
    # Code 0 is a word no item has, or the gap behind a text; no window matches it.
    codes = np.array([c for x in lists for c in (*[get(w, 0) for w in x], 0)], np.uint64)
    none = np.zeros(0, np.int64)
    if not len(q.size) or not len(codes):
        return counts, none, none, none
    starts = np.cumsum(counts + 1) - counts - 1
    keep = codes > 0
    if q.pairs is not None and len(q.pairs):
        pair = codes << np.uint64(32) | np.append(codes[1:], np.uint64(0))
        at = np.minimum(np.searchsorted(q.pairs, pair), len(q.pairs) - 1)
        keep &= q.pairs[at] == pair
    at = np.flatnonzero(keep)
    if not len(at):
        return counts, none, none, none
    packed = np.concatenate([_packed(codes, q.per_key), np.zeros(q.window + q.per_key, np.uint64)])
    arrays = [packed[at + k * q.per_key] for k in range(len(q.low))]
    order = np.lexsort(arrays[::-1])  # the shard's suffix array, to the depth of a window
    at, arrays = at[order], [a[order] for a in arrays]
    first, last = _bound(arrays, q.low, False), _bound(arrays, q.high, True)
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    place = at[rank]
    text = np.searchsorted(starts, place, "right") - 1
    return counts, text, place - starts[text], which


def _longest(at: np.ndarray, which: np.ndarray, q: Queries) -> int:
    """Words of the longest verbatim match: windows that follow each other in text and item."""
    runs: dict[tuple[int, int], list[int]] = {}
    best = 0
    for p, w in zip(at.tolist(), which.tolist()):
        best = max(best, int(q.size[w]))
        for item, s in q.uses[w]:
            runs.setdefault((item, p - s), []).append(p)
    for places in runs.values():
        places.sort()
        length = 1
        for a, b in zip(places, places[1:]):
            length = length + 1 if b == a + 1 else 1
            best = max(best, q.window + length - 1)
    return best


def _add_hits(batches, q: Queries):
    """Extend the columns ``spans`` (hit word ranges), ``items`` and ``longest`` of each row."""
    for batch in batches:
        for part in slices([batch], SHARD_ROWS):
            names = part.schema.names
            texts = [t or b"" for t in part.column(names.index("_text")).cast(pa.binary()).to_pylist()]
            counts, text, offset, which = occurrences(texts, q)
            spans, items, longest = (part.column(names.index(c)).to_pylist() for c in ("_spans", "_items", "_longest"))
            order = np.argsort(text, kind="stable")
            cut = np.searchsorted(text[order], np.arange(len(texts) + 1))
            for k in np.unique(text):
                mine = order[cut[k]:cut[k + 1]]
                at, w = offset[mine], which[mine]
                covered = np.zeros(counts[k] + 1, np.int64)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + q.size[w], -1)
                hit = np.diff(np.r_[0, (np.cumsum(covered)[:-1] > 0).astype(np.int8), 0])
                ranges = np.stack([np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)], 1).ravel().tolist()
                spans[k] = merge(spans[k] + ranges)
                items[k] = sorted({*items[k], *(q.names[i] for x in np.unique(w) for i, _ in q.uses[x])})
                longest[k] = max(longest[k], _longest(at, w, q))
            new = {"_words": pa.array(counts), "_spans": pa.array(spans, pa.list_(pa.int64())),
                   "_items": pa.array(items, pa.list_(pa.string())), "_longest": pa.array(longest, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, part.column(k)) for k, c in enumerate(names)], schema=part.schema)


def merge(flat: list[int]) -> list[int]:
    """Union of word ranges given as start, stop, start, stop, ..."""
    out: list[int] = []
    for start, stop in sorted(zip(flat[::2], flat[1::2])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], stop)
        else:
            out += [start, stop]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items dealt to blocks whose measured size is within the limit (or one item each)."""
    items = narrow(benchmark, "item_id", "text").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null")))
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)
    total = items.agg(size).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        worst = dealt.groupBy("block").agg(size.alias("n"), F.count("*").alias("k")).where(
            (F.col("n") > 2 * block_bytes) & (F.col("k") > 1)).limit(1).count() if blocks > 1 else 0
        if not worst or blocks > 100_000:
            return [dealt.where(F.col("block") == k).select("item_id", "text") for k in range(blocks)]
        blocks *= 2


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, *keep) -> DataFrame:
    empty = F.array().cast("array<bigint>")
    rows = docs.select(*keep, F.col("text").alias("_text"), F.lit(0).cast("long").alias("_words"), empty.alias("_spans"),
                       F.array().cast("array<string>").alias("_items"), F.lit(0).cast("long").alias("_longest"))
    context = docs.sparkSession.sparkContext
    for block in _blocks(benchmark, block_bytes):
        sent = context.broadcast(vars(prepare([(r.item_id, r.text) for r in block.collect()], window)))
        rows = rows.mapInArrow(lambda batches, sent=sent: _add_hits(batches, Queries(**sent.value)), rows.schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and
    ``items`` (ids as text), ``spans`` (hit word ranges: start, stop, ...), ``longest`` (words of
    the longest verbatim match).

    No shuffle of the documents.  Null texts have no words; an item without words has no
    window; a null ``item_id`` counts as the item ``null``; items that repeat an id are one item.
    Empty tables and repeated rows need no special case; other columns are not read.
    """
    ids = F.concat_ws(",", "_items")
    length = F.aggregate(F.transform("_spans", lambda v, k: F.when(k % 2 == 0, -v).otherwise(v)),
                         F.lit(0).cast("long"), lambda a, v: a + v)
    return _hits(docs, benchmark, window, block_bytes, F.col("doc_id")).select(
        "doc_id", F.col("_words").alias("n_words"), length.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (length > 0).alias("contaminated"),
        F.col("_items").alias("items"), F.col("_spans").alias("spans"), F.col("_longest").alias("longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no window of the benchmark."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return _hits(docs, benchmark, window, block_bytes, row).where(F.size("_items") == 0).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
