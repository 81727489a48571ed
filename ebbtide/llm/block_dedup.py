"""Word passages that an earlier document has too, found by fixed-block anchors.

A window of 13 words holds a whole block of 7 wherever the blocks of its document lie.  So the
non-overlapping blocks of all documents are the index, and every rolling 7-word window of
every document probes it.  Probes that hit mark places; the 13-word windows around the marked
places are the maximal exact repeats' only possible windows, and they are compared over all
documents by the least ``doc_id`` that has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import blobs
from ebbtide.llm.blobs import (
    ANCHOR_BITS, byte_slices, mix, pack, pack_signed, pack_sorted, range_bits, unpack, unpack_signed, unpack_sorted,
)
from ebbtide.llm.common import bytes_of, id_type, map_rows, text_code, text_code_column

WINDOW, BLOCK = 13, 7
#: Text bytes that a task works on at once, and hashes that meet in one range.
SLICE_BYTES, RANGE_HASHES = 8_000_000, 1_000_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Slice:
    """Word hashes of some documents, one after the other."""

    ids: np.ndarray      # doc_id of each document
    starts: np.ndarray   # first word of each document, and the end of the last
    codes: list[bytes]   # ``text_code`` of each text, to tell rows with the same doc_id apart
    words: np.ndarray    # 64-bit hash of each word

    def left(self) -> np.ndarray:
        """Words from each place to the end of its document."""
        n = np.diff(self.starts)
        return np.repeat(self.starts[1:], n) - np.arange(self.starts[-1])

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))


def make_slice(ids: list[int], texts: list[bytes]) -> Slice:
    import xxhash

    lists = [t.split() for t in texts]  # bytes split at space and 0x09-0x0D only
    codes = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    known = np.array([digest(w) for w in codes.dictionary.to_pylist()], np.uint64)
    words = known[codes.indices.to_numpy()] if len(codes) else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, lists)])
    return Slice(np.array(ids, np.int64), starts, [text_code(t) for t in texts], words)


def rolling(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of the ``size`` words from each place (too short at the end: meaningless)."""
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = np.zeros(len(words), np.uint64)
    for k in range(size):
        out = out * base + padded[k:k + len(words)]
    return mix(out)


def _anchor_rows(part: pa.RecordBatch, bits: int) -> Iterator[tuple[int, bytes]]:
    """Per hash range the distinct 7-word windows of a slice, with two flags.

    Flag 1: it is a block of the index.  Flag 2: two documents of the slice have it.
    """
    made = make_slice(part.column(0).to_pylist(), bytes_of(part.column(1)))
    good = np.flatnonzero(made.left() >= BLOCK)
    anchors = rolling(made.words, BLOCK, _BASES[0])[good] >> np.uint64(64 - ANCHOR_BITS)
    documents = made.documents()
    block = (good - made.starts[documents[good]]) % BLOCK == 0
    order = np.argsort(anchors, kind="stable")
    anchors, documents, block = anchors[order], made.ids[documents[good][order]], block[order]
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else np.zeros(0, np.int64)
    if not len(first):
        return
    several = np.r_[False, (anchors[1:] == anchors[:-1]) & (documents[1:] != documents[:-1])]
    flags = np.maximum.reduceat(block, first).astype(np.uint64) | np.maximum.reduceat(several, first).astype(np.uint64) << np.uint64(1)
    anchors = anchors[first]
    edges = np.searchsorted(anchors >> np.uint64(ANCHOR_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for r in range(1 << bits):
        a, b = edges[r], edges[r + 1]
        if b > a:
            yield r, pack_sorted(anchors[a:b] << np.uint64(2) | flags[a:b])


def _hit_filter(table: pa.Table, bits: int, exponent: int) -> pa.Table:
    """The filter bits of a range: index blocks that another document's window hits."""
    run = np.concatenate([unpack_sorted(b) for b in table.column("body").to_pylist()])
    run.sort()
    anchors, flags = run >> np.uint64(2), run & np.uint64(3)
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    count = np.diff(np.r_[first, len(run)])
    either = np.bitwise_or.reduceat(flags, first)
    hit = anchors[first][((either & 1) > 0) & ((count > 1) | (either >= 2))]
    return pa.table({"rng": pa.array([table.column("rng")[0].as_py()], pa.int32()),
                     "body": pa.array([blobs.filter_part(hit, bits, exponent)], pa.binary())})


def _window_rows(part: pa.RecordBatch, bits: int, field: np.ndarray) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Per hash range the 13-word windows around marked places: hashes, places and ``doc_id``.

    One more row, of three values, tells the documents of the slice; it passes through a range.
    """
    made = make_slice(part.column(0).to_pylist(), bytes_of(part.column(1)))
    left = made.left()
    mark = (left >= BLOCK) & blobs.passes(rolling(made.words, BLOCK, _BASES[0]) >> np.uint64(64 - ANCHOR_BITS), field, bits)
    near = np.concatenate([[0], np.cumsum(mark)])
    last = np.minimum(np.arange(len(mark)) + WINDOW - BLOCK + 1, len(mark))
    at = np.flatnonzero((left >= WINDOW) & (near[last] > near[:-1]))
    if not len(at):
        return
    hashes = rolling(made.words, WINDOW, _BASES[0])[at]
    check = rolling(made.words, WINDOW, _BASES[1])[at] >> np.uint64(48)
    order = np.argsort(hashes, kind="stable")
    hashes, check, at = hashes[order], check[order], at[order]
    about = [pack_signed(made.ids), pack(np.diff(made.starts).astype(np.uint64)), b"".join(made.codes)]
    name = hashlib.md5(b"".join(about) + made.words.tobytes()).digest()
    yield int.from_bytes(name[:4], "little") >> (32 - bits), name, about
    ids = made.ids[made.documents()[at]]
    edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for r in range(1 << bits):
        a, b = edges[r], edges[r + 1]
        if b > a:
            yield r, name, [pack_sorted(hashes[a:b]), pack(check[a:b]), pack(at[a:b].astype(np.uint64)), pack_signed(ids[a:b])]


def _later_windows(table: pa.Table) -> pa.Table:
    """Of the windows of a range, the places whose window an earlier document has."""
    bodies, slices = table.column("body").to_pylist(), table.column("slice").to_pylist()
    rows = [(slices[k], body) for k, body in enumerate(bodies) if len(body) == 3]
    runs = [k for k, body in enumerate(bodies) if len(body) == 4]
    if not runs:
        return _named(rows)
    hashes = np.concatenate([unpack_sorted(bodies[k][0]) for k in runs])
    checks = np.concatenate([unpack(bodies[k][1]) for k in runs])
    parts = [unpack(bodies[k][2]).view(np.int64) for k in runs]
    places, origin = np.concatenate(parts), np.repeat(runs, [len(p) for p in parts])
    ids = np.concatenate([unpack_signed(bodies[k][3]) for k in runs])
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.r_[first, len(h)]))
    later = order[ids[order] > least]
    later = later[np.lexsort((places[later], origin[later]))]
    cut = np.flatnonzero(np.diff(origin[later])) + 1
    for mine in np.split(later, cut) if len(later) else []:
        rows.append((slices[int(origin[mine[0]])], [pack_sorted(places[mine].astype(np.uint64))]))
    return _named(rows)


def _named(rows: list[tuple[bytes, list[bytes]]]) -> pa.Table:
    return pa.table({"slice": pa.array([r[0] for r in rows], pa.binary()),
                     "body": pa.array([r[1] for r in rows], pa.list_(pa.binary()))})


def _spans(table: pa.Table, window: int) -> pa.Table:
    """Removed word ranges of the documents of one slice."""
    bodies = table.column("body").to_pylist()
    # Slices with the same rows have the same name, documents and places.
    ids, sizes, codes = next((unpack_signed(b[0]), unpack(b[1]).view(np.int64), b[2]) for b in bodies if len(b) == 3)
    ends = np.cumsum(sizes)
    at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(b[0]) for b in bodies if len(b) == 1)]).view(np.int64))
    document = np.searchsorted(ends, at, "right")
    head = np.flatnonzero(np.r_[True, (document[1:] != document[:-1]) | (at[1:] > at[:-1] + window)][:len(at)])
    tail = np.r_[head[1:], len(at)].astype(np.int64)[:len(head)] - 1
    own = document[head]
    flat = np.stack([at[head], at[tail] + window], 1) - (ends - sizes)[own][:, None]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][:len(own)])
    bounds = np.r_[first, len(own)]
    return pa.table({"doc_id": pa.array(ids[own[first]]),
                     "code": pa.array([codes[16 * k:16 * k + 16] for k in own[first].tolist()], pa.binary()),
                     "spans": pa.array([flat[a:b].ravel().tolist() for a, b in zip(bounds, bounds[1:])], pa.list_(pa.int64()))})


def _emit(batches, work, schema: pa.Schema):
    for part in byte_slices(batches, 1, SLICE_BYTES):
        rows = list(work(part))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, code, spans`` of the documents with words that an earlier one has.

    ``code`` (128 bits of the text) tells rows with one ``doc_id`` apart; equal rows have equal spans.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = range_bits(total // 6, RANGE_HASHES)
    exponent = blobs.filter_exponent(total // 6 // BLOCK, bits)
    first = pa.schema([("rng", pa.int32()), ("body", pa.binary())])
    anchors = rows.mapInArrow(lambda b: _emit(b, lambda p: _anchor_rows(p, bits), first), "rng int, body binary")
    fields = anchors.groupBy("rng").applyInArrow(lambda t: _hit_filter(t, bits, exponent), "rng int, body binary").toArrow()
    field = blobs.whole_filter(fields.column("rng").to_pylist(), fields.column("body").to_pylist(), bits, exponent)
    sent = spark.sparkContext.broadcast(field)
    second = pa.schema([("rng", pa.int32()), ("slice", pa.binary()), ("body", pa.list_(pa.binary()))])
    windows = rows.mapInArrow(lambda b: _emit(b, lambda p: _window_rows(p, bits, sent.value), second),
                              "rng int, slice binary, body array<binary>")
    later = windows.groupBy("rng").applyInArrow(_later_windows, "slice binary, body array<binary>")
    return later.groupBy("slice").applyInArrow(lambda t: _spans(t, WINDOW), "doc_id long, code binary, spans array<long>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256`` and ``kept_text`` (kept words joined
    by one space).

    Rows with one ``doc_id`` are no earlier document to each other.  A null ``doc_id`` has no
    order: such a row keeps its words and removes none elsewhere.  A null text has no words.
    Repeated rows give repeated rows; empty tables give empty ones; other columns are not read.
    Hashes have 80 bits where they decide, and 40 where they only pick candidates.
    """
    found = (repeated_spans(docs).groupBy(F.col("doc_id").alias("_id"), F.col("code").alias("_code"))
             .agg(F.first("spans").alias("_spans")))
    rows = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("_own"), text_code_column(F.col("text")).alias("_text_code"))
    joined = (rows.join(found, (F.col("_own") == F.col("_id")) & (F.col("_text_code") == F.col("_code")), "left")
              .select("doc_id", "text", "_spans"))

    def work(batch):
        n_words, n_removed, kept_text, kept_hash = [], [], [], []
        for text, spans in zip(bytes_of(batch.column(1)), batch.column(2).to_pylist()):
            words = text.split()
            spans = spans or []
            kept, last = [], 0
            for a, b in zip(spans[::2], spans[1::2]):
                kept += words[last:a]
                last = b
            kept += words[last:]
            joined_words = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            kept_text.append(joined_words.decode())
            kept_hash.append(hashlib.sha256(joined_words).hexdigest())
        return [batch.column(0), n_words, n_removed, kept_hash, kept_text]

    schema = f"doc_id {id_type(docs)}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return map_rows(joined, schema, work)
