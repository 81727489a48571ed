"""Sorted hash runs as compressed values, so that Spark shuffles few large rows.

A task turns the hashes of a slice of documents into one sorted run per hash range and sends
each run as one binary value.  The rows of a range then meet in one task, whose size is that
of the range, whatever one key's frequency: a run holds a key once, or a position in 2-3 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bits of an anchor hash, and the most bits of a filter of anchors (16 MiB, whatever the input).
ANCHOR_BITS, FILTER_BITS = 40, 1 << 27
MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the information of a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(32))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as many byte planes as the largest needs, compressed."""
    import zstandard

    values = np.ascontiguousarray(values, dtype="<u8")
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    planes = blob[0]
    out = np.zeros((len(raw) // planes, 8), np.uint8)
    out[:, :planes] = raw.reshape(planes, -1).T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def pack_signed(values: np.ndarray) -> bytes:
    """Signed integers that tend to follow each other, as differences."""
    step = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return pack(((step << 1) ^ (step >> 63)).view(np.uint64))


def unpack_signed(blob: bytes) -> np.ndarray:
    step = unpack(blob)
    return np.cumsum((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64))


def range_bits(elements: int, per_range: int) -> int:
    """Leading hash bits that cut ``elements`` into ranges of about ``per_range``."""
    return min(max((max(elements, 1) // per_range).bit_length(), 4), FILTER_BITS.bit_length() - 5)


def _slots(anchors: np.ndarray, low_bits: int, size_bits: int) -> list[np.ndarray]:
    """Three places of each anchor in the part of the filter that its range owns."""
    spread = mix((anchors & np.uint64((1 << low_bits) - 1)) + np.uint64(1))
    mask = np.uint64((1 << size_bits) - 1)
    return [(spread >> np.uint64(s)) & mask for s in (0, 20, 40)]


def filter_exponent(elements: int, bits: int) -> int:
    """Size of a filter as a power of two: 16 bits an element, within the limits."""
    most = FILTER_BITS.bit_length() - 1
    return min(max((16 * max(elements, 1)).bit_length(), 16, bits + 4), most)


def filter_part(anchors: np.ndarray, bits: int, exponent: int) -> bytes:
    """The part of the filter of one range (``bits`` leading bits), with its anchors set."""
    field = np.zeros(1 << exponent - bits, bool)
    for slot in _slots(anchors, ANCHOR_BITS - bits, exponent - bits):
        field[slot] = True
    return np.packbits(field, bitorder="little").tobytes()


def whole_filter(ranges: list[int], parts: list[bytes], bits: int, exponent: int) -> np.ndarray:
    """The filter from the parts of its ranges."""
    size = 1 << exponent - bits >> 3
    field = np.zeros(1 << exponent >> 3, np.uint8)
    for r, part in zip(ranges, parts):
        field[r * size:(r + 1) * size] = np.frombuffer(part, np.uint8)
    return field


def passes(anchors: np.ndarray, field: np.ndarray, bits: int) -> np.ndarray:
    """Which anchors may be set; a wrong yes costs work only."""
    size_bits = (8 * len(field)).bit_length() - 1 - bits
    base = (anchors >> np.uint64(ANCHOR_BITS - bits)) << np.uint64(size_bits)
    out = np.ones(len(anchors), bool)
    for slot in _slots(anchors, ANCHOR_BITS - bits, size_bits):
        at = base + slot
        out &= ((field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return out


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about ``most`` bytes together; a longer text is one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if s is None else s for s in pa.compute.binary_length(batch.column(column).cast(pa.binary())).to_pylist()])
        group = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
