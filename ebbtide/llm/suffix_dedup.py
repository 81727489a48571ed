"""Repeated byte strings of whole texts, by suffix sorting with a difference cover.

Suffixes are dealt to tasks so that equal 200-byte strings meet: the anchor of a string is its
48-byte substring of least hash, and neighbouring strings with one anchor travel together as
one piece of text.  Anchors that occur once need not travel.  Each task sorts the suffixes of
its pieces: it sorts the triples at two of three positions, recurses on their names until these
cover 200 bytes, sorts the remaining suffixes by their first byte and the rank that
follows, merges both by counting, and compares the prefixes of neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import blobs
from ebbtide.llm.blobs import (
    ANCHOR_BITS, byte_slices, mix, pack, pack_signed, pack_sorted, range_bits, unpack, unpack_signed, unpack_sorted,
)
from ebbtide.llm.common import bytes_of, id_type, map_rows, text_code, text_code_column

LENGTH, ANCHOR = 200, 48
#: Text bytes of a slice (a longer text is one), of a hash range, and of one suffix array.
SLICE_BYTES, RANGE_BYTES, ARRAY_BYTES = 4_000_000, 4_000_000, 400_000
MOST_TASKS = 8192
#: Runs beyond which an anchor is common, and its strings are dealt out further.
COMMON = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = np.uint64(64 - ANCHOR_BITS)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
#: Places worked on at once; the place in a block has to fit in the low 24 bits of a key.
_BLOCK = 1 << 15


# Difference-cover suffix sorting ------------------------------------------------------------

def packed(columns: list[np.ndarray]) -> np.ndarray:
    """One non-negative number per row, in the order of the rows' values."""
    key = columns[0].astype(np.int64)
    top = int(key.max(initial=0)) + 1
    for column in columns[1:]:
        size = int(column.max(initial=0)) + 1
        if top * size >= 1 << 62:
            key = dense(key)
            top = int(key.max(initial=0)) + 1
        key, top = key * size + column, top * size
    return key


def dense(key: np.ndarray) -> np.ndarray:
    """Names 1, 2, ... of numbers in their order, equal numbers equal."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.argsort(key)
    ranked = key[order]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
    return names


def _counts_below(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per left value how many left and how many right values are less; per right value how many left ones."""
    by_left, by_right = np.argsort(left), np.argsort(right)
    l, r = left[by_left], right[by_right]  # sorted queries keep the binary searches close together
    own, across, back = np.empty(len(l), np.int64), np.empty(len(l), np.int64), np.empty(len(r), np.int64)
    own[by_left] = np.searchsorted(l, l)
    across[by_left] = np.searchsorted(r, l)
    back[by_right] = np.searchsorted(l, r)
    return own, across, back


def suffix_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes that respect the order of their first ``depth`` symbols.

    Suffixes that differ there are ranked as they differ; equal ones are neighbours.
    """
    n = len(symbols)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, np.int64)])
    if depth <= 1 or n < 3:
        return dense(packed([s[k:k + n] for k in range(3)]))
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names = dense(packed([s[sample], s[sample + 1], s[sample + 2]]))
    if depth > 3 and len(names) and int(names.max()) < len(names):
        # A gap between the two halves ends the first one.
        inner = suffix_ranks(np.concatenate([names[:len(one)], [0], names[len(one):]]), -(-depth // 3))
        names = np.concatenate([inner[:len(one)], inner[len(one) + 1:]])
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    number = np.bincount(names, minlength=1)
    below = np.cumsum(number) - number
    # The remaining suffixes are compared with those at positions 1 mod 3 by a symbol and a
    # rank, with those at 2 mod 3 by two symbols and a rank.
    at = np.concatenate([zero, one])
    key = packed([s[at], rank[at + 1]])
    own, less_one, one_zero = _counts_below(key[:len(zero)], key[len(zero):])
    at = np.concatenate([zero, two])
    key = packed([s[at], s[at + 1], rank[at + 2]])
    _, less_two, two_zero = _counts_below(key[:len(zero)], key[len(zero):])
    out = np.empty(n, np.int64)
    out[zero] = own + less_one + less_two
    out[one] = below[rank[one]] + one_zero
    out[two] = below[rank[two]] + two_zero
    return out + 1


def equal_neighbours(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in ``order`` (but the first) has the first ``length`` bytes of the one before."""
    # Eight bytes from each place as one number; the last comparison overlaps the one before.
    wide = np.lib.stride_tricks.sliding_window_view(text, 8)
    words = np.ascontiguousarray(wide).view(np.uint64).ravel()
    same = np.arange(1, len(order))
    for step in [*range(0, length - 8, 8), length - 8]:
        same = same[words[order[same - 1] + step] == words[order[same] + step]]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[same - 1] = True
    return out


def repeated_starts(pieces: list[bytes], windows: list[int], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Per piece, which of its first ``windows`` strings of ``length`` bytes occur twice.

    A piece stands for ``copies`` places.  The pieces are one text with gaps, sorted as such.
    """
    size = np.array([len(p) for p in pieces])
    base = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"\0".join(pieces) + bytes(length), np.uint8)
    symbols = joined[:base[-1] + size[-1]].astype(np.int64) + 1
    symbols[(base + size)[:-1]] = 0
    ranks = suffix_ranks(symbols, length)
    counts = np.array(windows)
    owner = np.repeat(np.arange(len(pieces)), counts)
    start = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(ranks[start])
    same = equal_neighbours(joined, start[order], length)
    first = np.flatnonzero(np.r_[True, ~same])
    weight = np.add.reduceat(np.array(copies)[owner[order]], first)
    often = np.empty(len(order), bool)
    often[order] = np.repeat(weight > 1, np.diff(np.r_[first, len(order)]))
    return np.split(often, np.cumsum(counts)[:-1])


# Anchors -----------------------------------------------------------------------------------

def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of the ``width`` values from each place."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    if reach < width:
        values = np.minimum(values[:reach - width], values[width - reach:])
    return values


def _substring_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place."""
    h, reach, factor = _BYTES[data], 1, int(_BASE)
    parts, at = None, 0
    while True:
        if width & reach:  # the binary digits of the width, one after the other
            here = h[at:]
            if parts is None:
                parts = here
            else:
                n = min(len(parts), len(here))
                parts = parts[:n] * np.uint64(factor | 1)
                parts += here[:n]
            at += reach
        if reach * 2 > width:
            return mix(parts)
        left = h[:-reach] * np.uint64(factor)
        left += h[reach:]
        h = left
        factor = (factor * factor + 0x632BE5AB) & 0xFFFFFFFFFFFFFFFF | 1
        reach *= 2


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring 200-byte strings with one anchor, over the joined texts.

    Returns the anchor hash, the place of the first string, the number of strings and the place
    of the anchor of each run.  The anchor is the leftmost 48 bytes of least hash, so it follows
    from the content.  The places are worked on block by block: the arrays stay small, and in
    the processor's cache, and a key holds the place in its block, however long the texts are.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    total = len(data) - LENGTH + 1
    if total <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    inside = np.zeros(total, bool)  # strings that lie in one text
    start = 0
    for text in texts:
        if len(text) >= LENGTH:
            inside[start:start + len(text) - LENGTH + 1] = True
        start += len(text)
    places, hashes, chosen = [], [], []
    low = np.uint64((1 << int(_PLACE_BITS)) - 1)
    for a in range(0, total, _BLOCK):
        keyed = _substring_hashes(data[a:a + _BLOCK + LENGTH - 1], ANCHOR)
        keyed >>= _PLACE_BITS
        keyed <<= _PLACE_BITS
        keyed |= np.arange(len(keyed), dtype=np.uint64)
        least = _least_of(keyed, LENGTH - ANCHOR + 1)
        part = inside[a:a + len(least)]
        edge = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (part[1:] != part[:-1])])
        places.append(edge + a)
        hashes.append(least[edge] >> _PLACE_BITS)
        chosen.append((least[edge] & low).astype(np.int64) + a)
    first, anchors, place = np.concatenate(places), np.concatenate(hashes), np.concatenate(chosen)
    # A run that goes on in the next block is one run; one place has one hash.
    fresh = np.r_[True, (place[1:] != place[:-1]) | (inside[first[1:]] != inside[first[:-1]])]
    first, anchors, place = first[fresh], anchors[fresh], place[fresh]
    count = np.diff(np.r_[first, total])
    keep = inside[first]
    # Neighbouring texts never share a run: 199 bytes lie between their strings.
    # Least hashes are small numbers: they are mixed again, so that all ranges get their share.
    return mix(anchors[keep]) >> _PLACE_BITS, first[keep], count[keep], place[keep]


def _anchor_rows(part: pa.RecordBatch, bits: int) -> Iterator[tuple[int, bytes]]:
    """Per hash range the distinct anchors of a slice, with their number of runs (63 at most)."""
    anchors = np.sort(anchor_runs(bytes_of(part.column(1)))[0])
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else np.zeros(0, np.int64)
    number = np.minimum(np.diff(np.r_[first, len(anchors)]), 63).astype(np.uint64)
    anchors = anchors[first]
    edges = np.searchsorted(anchors >> np.uint64(ANCHOR_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(edges)):
        a, b = edges[r], edges[r + 1]
        yield int(r), pack_sorted(anchors[a:b] << np.uint64(6) | number[a:b])


def _often_seen(table: pa.Table, bits: int, exponent: int) -> pa.Table:
    """Filter parts of a range: the anchors that occur twice, and those that are very common."""
    run = np.concatenate([unpack_sorted(b) for b in table.column("body").to_pylist()])
    run.sort()
    anchors = run >> np.uint64(6)
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    number = np.add.reduceat(run & np.uint64(63), first)
    return pa.table({"rng": pa.array([table.column("rng")[0].as_py()], pa.int32()),
                     "body": pa.array([blobs.filter_part(anchors[first][number > 1], bits, exponent)], pa.binary()),
                     "common": pa.array([blobs.filter_part(anchors[first][number > COMMON], bits, exponent)], pa.binary())})


def _split_common(anchors: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray,
                  joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a common anchor cut into parts of 8 strings or fewer, each with an anchor of its own.

    Strings at one distance from the anchor, in blocks of 8, all hold the 193 bytes that follow
    from the block.  The hash of these is the part's anchor, so equal strings still meet, and
    a passage that a third of all documents have is dealt to many ranges by what surrounds it.
    """
    import xxhash

    out = []
    for h, p, n, a in zip(anchors.tolist(), first.tolist(), count.tolist(), place.tolist()):
        for block in range((a - p - n + 1) // 8, (a - p) // 8 + 1):
            low, high = max(p, a - 8 * block - 7), min(p + n - 1, a - 8 * block)
            core = a - 8 * block
            own = xxhash.xxh3_64_intdigest(joined[core:core + LENGTH - 7], seed=h ^ block << 41) >> 64 - ANCHOR_BITS
            out.append((own, low, high - low + 1))
    own, first, count = zip(*out)
    return np.array(own, np.uint64), np.array(first, np.int64), np.array(count, np.int64)


def _piece_rows(part: pa.RecordBatch, bits: int, field: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Per hash range the pieces of text whose anchor may occur twice.

    One more row, of three values, tells the documents of the slice; it passes through the range.
    """
    import zstandard

    texts = bytes_of(part.column(1))
    joined = b"".join(texts)
    anchors, first, count, place = anchor_runs(texts)
    keep = blobs.passes(anchors, field, bits)
    anchors, first, count, place = anchors[keep], first[keep], count[keep], place[keep]
    if not len(anchors):
        return
    often = blobs.passes(anchors, common, bits)
    if often.any():
        parts = _split_common(anchors[often], first[often], count[often], place[often], joined)
        anchors, first, count = (np.concatenate([c[~often], x]) for c, x in zip((anchors, first, count), parts))
    # Equal pieces of the slice travel once: periodic texts and copies are mostly such.
    groups: dict[tuple[int, bytes], list[int]] = {}
    for h, p, n in zip(anchors.tolist(), first.tolist(), count.tolist()):
        groups.setdefault((h, joined[p:p + n + LENGTH - 1]), []).append(p)
    pieces = sorted(groups, key=lambda g: g[0])
    anchors = np.array([h for h, _ in pieces], np.uint64)
    ids = np.array(part.column(0).to_pylist(), np.int64)
    about = [pack_signed(ids), pack(np.array([len(t) for t in texts], np.uint64)),
             b"".join(text_code(t) for t in texts)]
    name = hashlib.md5(b"".join(about) + hashlib.md5(joined).digest()).digest()
    yield int.from_bytes(name[:4], "little") >> (32 - bits), name, about
    packer = zstandard.ZstdCompressor(level=3)
    edges = np.searchsorted(anchors >> np.uint64(ANCHOR_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(edges)):
        a, b = edges[r], edges[r + 1]
        mine = pieces[a:b]
        places = [groups[g] for g in mine]
        yield int(r), name, [pack_sorted(anchors[a:b]), pack(np.array([len(p) for _, p in mine], np.uint64)),
                             pack(np.array([len(x) for x in places], np.uint64)),
                             pack_signed(np.array([p for x in places for p in x], np.int64)),
                             packer.compress(b"".join(p for _, p in mine))]


def _runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, number) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _repeated_pieces(table: pa.Table) -> pa.Table:
    """Of the pieces of a hash range, the runs of strings that occur twice or more."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    bodies = table.column("body").to_pylist()
    places: dict[tuple[int, bytes], list[tuple[int, np.ndarray]]] = {}  # (anchor, piece) -> its places by row
    for k, values in enumerate(bodies):
        if len(values) == 3:
            continue
        anchors, size, number, first, body = values
        text, at = unpacker.decompress(body), 0
        mine = np.split(unpack_signed(first), np.cumsum(unpack(number).view(np.int64))[:-1])
        for anchor, n, where in zip(unpack_sorted(anchors).tolist(), unpack(size).tolist(), mine):
            places.setdefault((anchor, text[at:at + n]), []).append((k, where))
            at += n
    copies = {g: sum(len(where) for _, where in x) for g, x in places.items()}
    groups: dict[int, list[bytes]] = {}
    for anchor, piece in places:
        groups.setdefault(anchor, []).append(piece)
    found: list[tuple[int, bytes, list[tuple[int, int]]]] = []
    held: list[tuple[int, bytes]] = []

    def sort_held() -> None:
        flags = repeated_starts([p for _, p in held], [len(p) - LENGTH + 1 for _, p in held], [copies[h] for h in held])
        found.extend((*h, runs) for h, f in zip(held, flags) if (runs := _runs_of(f)))
        held.clear()

    size = 0
    for anchor, pieces in groups.items():
        if len(pieces) == 1:
            if copies[anchor, pieces[0]] > 1:
                found.append((anchor, pieces[0], [(0, len(pieces[0]) - LENGTH + 1)]))
            continue
        held += [(anchor, p) for p in pieces]
        size += sum(map(len, pieces))
        if size > ARRAY_BYTES:
            sort_held()
            size = 0
    if held:
        sort_held()
    hits: dict[int, list[tuple[np.ndarray, int]]] = {}
    for anchor, piece, runs in found:
        for k, where in places[anchor, piece]:
            hits.setdefault(k, []).extend((where + a, n) for a, n in runs)
    slices = table.column("slice").to_pylist()
    about = [k for k, values in enumerate(bodies) if len(values) == 3]
    names, rows = [slices[k] for k in about], [bodies[k] for k in about]
    for k, runs in hits.items():
        start = np.concatenate([x for x, _ in runs])
        number = np.repeat([n for _, n in runs], [len(x) for x, _ in runs])
        order = np.argsort(start)
        names.append(slices[k])
        rows.append([pack_sorted(start[order].astype(np.uint64)), pack(number[order].astype(np.uint64))])
    return pa.table({"slice": pa.array(names, pa.binary()), "body": pa.array(rows, pa.list_(pa.binary()))})


def _spans(table: pa.Table) -> pa.Table:
    """Removed byte ranges of the documents of one slice."""
    bodies = table.column("body").to_pylist()
    # Slices with the same rows have the same name, documents and runs.
    ids, size, codes = next((unpack_signed(b[0]), unpack(b[1]).view(np.int64), b[2]) for b in bodies if len(b) == 3)
    runs = [b for b in bodies if len(b) == 2]
    stop = np.cumsum(size)
    start = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(b[0]) for b in runs)]).view(np.int64)
    end = start + np.concatenate([np.zeros(0, np.uint64), *(unpack(b[1]) for b in runs)]).view(np.int64) + LENGTH - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    document = np.searchsorted(stop, start, "right")
    reach = np.maximum.accumulate(end)  # no range leaves its document, so this respects documents too
    head = np.flatnonzero(np.r_[True, (document[1:] != document[:-1]) | (start[1:] > reach[:-1])][:len(start)])
    tail = np.r_[head[1:], len(start)].astype(np.int64)[:len(head)] - 1
    own = document[head]
    flat = np.stack([start[head], reach[tail]], 1) - (stop - size)[own][:, None]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][:len(own)])
    bounds = np.r_[first, len(own)]
    return pa.table({"doc_id": pa.array(ids[own[first]]),
                     "code": pa.array([codes[16 * k:16 * k + 16] for k in own[first].tolist()], pa.binary()),
                     "spans": pa.array([flat[a:b].ravel().tolist() for a, b in zip(bounds, bounds[1:])], pa.list_(pa.int64()))})


def _emit(batches, work, schema: pa.Schema):
    for part in byte_slices(batches, 1, SLICE_BYTES):
        rows = list(work(part))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``key, code, spans`` of the texts of ``(key, text)`` with repeated strings.

    ``code`` (128 bits of the text) tells rows with one key apart; equal texts have equal spans.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = range_bits(total, RANGE_BYTES)
    exponent = blobs.filter_exponent(total // (LENGTH - ANCHOR) * 2, bits)
    first = pa.schema([("rng", pa.int32()), ("body", pa.binary())])
    anchors = rows.mapInArrow(lambda b: _emit(b, lambda p: _anchor_rows(p, bits), first), "rng int, body binary")
    parts = anchors.groupBy("rng").applyInArrow(lambda t: _often_seen(t, bits, exponent), "rng int, body binary, common binary").toArrow()
    ranges = parts.column("rng").to_pylist()
    twice, common = (blobs.whole_filter(ranges, parts.column(c).to_pylist(), bits, exponent) for c in ("body", "common"))
    sent = rows.sparkSession.sparkContext.broadcast((twice, common))
    second = pa.schema([("rng", pa.int32()), ("slice", pa.binary()), ("body", pa.list_(pa.binary()))])
    pieces = rows.mapInArrow(lambda b: _emit(b, lambda p: _piece_rows(p, bits, *sent.value), second),
                             "rng int, slice binary, body array<binary>")
    # A fixed number of partitions: the compressed sizes say little about the work in a range.
    dealt = pieces.repartition(min(1 << bits, MOST_TASKS), "rng")
    runs = dealt.groupBy("rng").applyInArrow(_repeated_pieces, "slice binary, body array<binary>")
    return runs.groupBy("slice").applyInArrow(_spans, "doc_id long, code binary, spans array<long>")


def _with_spans(docs: DataFrame, *columns) -> DataFrame:
    """The rows with ``_text`` and the ranges found for their key and text.

    Rows without an id share a key, but are joined, and dealt out, by their texts.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))
    found = (repeated_spans(docs.select(key.alias("doc_id"), "text"))
             .groupBy(F.col("doc_id").alias("_key"), F.col("code").alias("_code")).agg(F.first("spans").alias("_found")))
    rows = docs.select(*columns, F.col("text").alias("_text"), key.alias("_own"), text_code_column(F.col("text")).alias("_text_code"))
    same = (F.col("_own") == F.col("_key")) & (F.col("_text_code") == F.col("_code"))
    return rows.join(found, same, "left").drop("_key", "_own", "_code", "_text_code")


def _cut(text: bytes, spans: list[int] | None) -> tuple[bytes, int]:
    """The text without its repeated ranges, and their number."""
    spans = spans or []
    edges = [0, *spans, len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), len(spans) // 2


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the bytes).

    Every byte in a 200-byte string that also starts elsewhere goes, in all its places.  A null
    text is empty.  Repeated rows are places of their own, so they remove each other, also
    with a null ``doc_id``.  Empty tables give empty ones; other columns are not read.
    """
    def work(batch):
        out = [[], [], [], [], []]
        for text, spans in zip(bytes_of(batch.column(1)), batch.column(2).to_pylist()):
            kept, n = _cut(text, spans)
            for column, v in zip(out, (len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(v)
        return [batch.column(0), *out]

    schema = f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return map_rows(_with_spans(docs, F.col("doc_id")), schema, work)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the kept bytes as ``text``.

    A cut may fall inside a character; bytes that are no whole character then go too.  A null
    text stays null, and ``n_chars``, if there, is counted again for changed texts.
    """
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")
    frame = _with_spans(docs, row).select("_row", "_text", "_found")

    def work(batch):
        kept = [_cut(t or b"", s)[0].decode(errors="ignore") if t is not None else None
                for t, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())]
        return [batch.column(0), kept]

    done = map_rows(frame, f"_row {frame.schema['_row'].dataType.simpleString()}, _kept string", work)
    counted = F.length("_kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in rest else None
    return done.select(*[F.col("_kept").alias("text") if c == "text" else counted.alias("n_chars") if c == "n_chars"
                         else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
