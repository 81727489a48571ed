"""Encoding and decoding of whole texts with reuse of chunks that documents share.

Texts are cut into chunks where a rolling hash of the last bytes meets a condition, so equal
passages give equal chunks wherever they stand.  A chunk found in two documents or more is
encoded once, in a dictionary.  A document that holds such chunks takes their ids from it
and encodes only the rest.  A cut may fall inside a word, so the ids around a join come from
re-encoding the text between the nearest stable boundaries (see ``encoder``), and the window
is widened until it agrees with the ids kept on both sides.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import bytes_of, id_type, map_rows, narrow, worker_store
from ebbtide.llm.encoder import Encoder, worker_encoder
from ebbtide.sources.staging import new_path, stage

LEAST_CHUNK, MASK_BITS, MOST_CHUNK = 128, 9, 4096
#: Most bits of the filter that says which chunk hashes are shared: 8 MiB, whatever the input.
FILTER_BITS = 1 << 26
#: Text bytes that one task of the last step holds.
BUCKET_BYTES = 4_000_000
_STEPS = ((1, 0x9E3779B1), (2, 0x85EBCA6B), (4, 0xC2B2AE35), (8, 0x27D4EB2F), (16, 0x165667B1))


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes that end at each position."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    for width, factor in _STEPS:
        h[width:] = h[width:] + h[:-width] * np.uint32(factor)  # the right side is read first
    return h * np.uint32(0x2C1B3C6D)


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """End offsets of the chunks of each text; cuts are between characters."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if not len(joined):
        return [[] for _ in texts]
    free = np.append((joined & 0xC0) != 0x80, True)
    marked = np.flatnonzero((_rolling(joined) >> np.uint32(32 - MASK_BITS)) == 0) + 1 if len(joined) > 32 else np.zeros(0, np.int64)
    out, start = [], 0
    for text in texts:
        stop, last, ends = start + len(text), start, []
        a, b = np.searchsorted(marked, (start + LEAST_CHUNK, stop))
        for c in [*marked[a:b].tolist(), stop]:
            while c - last > MOST_CHUNK:
                last += MOST_CHUNK
                while not free[last]:
                    last -= 1
                ends.append(last - start)
            if c - last >= LEAST_CHUNK and free[c] and c < stop:
                ends.append(c - start)
                last = c
        if stop > start:
            ends.append(stop - start)
        out.append(ends)
        start = stop
    return out


def chunks_of(text: bytes, ends: list[int]) -> list[bytes]:
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def short_hash(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


class Filter:
    """Which chunk hashes may be shared; a wrong yes costs work only."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def flags(self, keys: list[bytes]) -> np.ndarray:
        slot = np.array([short_hash(k) for k in keys], np.int64) & (64 * len(self.bits) - 1)
        return ((self.bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def shared_filter(docs: DataFrame) -> Filter:
    """Hashes of chunks in two rows or more, as a bit field of a limited size.

    Counts are combined in the tasks and before the shuffle; the field reaches the driver as at
    most ``FILTER_BITS / 64`` words.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(max(1 << (total // LEAST_CHUNK).bit_length() + 2, 1 << 16), FILTER_BITS)

    def count(batch):
        texts, seen = bytes_of(batch.column(0)), {}
        for text, ends in zip(texts, chunk_ends(texts)):
            for key in {digest(c) for c in chunks_of(text, ends)}:
                seen[short_hash(key)] = seen.get(short_hash(key), 0) + 1
        return [list(seen), list(seen.values())]

    counts = map_rows(narrow(docs, "text"), "h long, n long", count).groupBy("h").agg(F.sum("n").alias("n"))
    slot = F.col("h").bitwiseAND(F.lit(size - 1))
    words = (counts.where("n > 1").groupBy(F.shiftrightunsigned(slot, 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow())
    bits = np.zeros(size // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Filter(bits)


@dataclass
class Entry:
    """Ids of a chunk between its first and last stable boundary, and what joins need."""

    pieces: int      # 1: the chunk has no stable boundary, all of it belongs to the joins
    head: int        # characters before the first boundary
    tail: int        # characters after the last one
    first: int       # characters and ids of the first and the last kept piece, for the check of a join
    first_ids: int
    last: int
    last_ids: int
    ids: bytes


def make_entry(encoder: Encoder, text: str) -> Entry:
    pieces, ids = encoder.pieces(text)
    kept = ids[1:-1]
    if len(pieces) == 1:
        return Entry(1, len(text), 0, 0, 0, 0, 0, b"")
    if not kept:
        return Entry(2, len(pieces[0]), len(pieces[-1]), 0, 0, 0, 0, b"")
    return Entry(len(pieces), len(pieces[0]), len(pieces[-1]), len(pieces[1]), len(kept[0]) // 4,
                 len(pieces[-2]), len(kept[-1]) // 4, b"".join(kept))


def splice(encoder: Encoder, texts: list[str], entries: list[Entry]) -> bytes:
    """Ids of the joined chunk texts: kept ids, and re-encoded joins that agree with them."""
    joins: list[str] = []       # text of each join, in order
    wide: list[tuple[str, bytes, bytes, str]] = []  # the same with one kept piece on either side
    kept: list[bytes] = []
    open_text, before, before_ids = "", "", b""
    for text, e in zip(texts, entries):
        if e.pieces == 1:
            open_text += text
            continue
        open_text += text[:e.head]
        joins.append(open_text)
        after, after_ids = text[e.head:e.head + e.first], e.ids[:4 * e.first_ids]
        wide.append((before, before_ids, after_ids, after))
        kept.append(e.ids)
        stop = len(text) - e.tail
        open_text = text[stop:]
        before, before_ids = (text[stop - e.last:stop], e.ids[len(e.ids) - 4 * e.last_ids:]) if e.ids else ("", b"")
    joins.append(open_text)
    wide.append((before, before_ids, b"", ""))
    ids = encoder.ids_many(joins)
    again = encoder.ids_many([b + j + a for j, (b, _, _, a) in zip(joins, wide)])
    if any(x != b + j + a for x, j, (_, b, a, _) in zip(again, ids, wide)):
        return encoder.direct(["".join(texts)])[0]  # widened to the whole text
    return b"".join(x for pair in zip(ids, [*kept, b""]) for x in pair)


class Decoder:
    """Bytes of each token id; joined and read as UTF-8 they are the decoded text."""

    def __init__(self, encoder: Encoder):
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        alphabet = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.token: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            whole = all(c in alphabet for c in token)
            self.token[i] = bytes(alphabet[c] for c in token) if whole else token.encode()

    def text(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _result(encoder: Encoder, ids: list[bytes]) -> list[list]:
    decoder = worker_store(f"decoder:{id(encoder)}", lambda: Decoder(encoder))
    decoded = [hashlib.sha256(decoder.text(x).encode()).hexdigest() for x in ids]
    return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], decoded]


_RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sort_out(docs: DataFrame, tokenizer: str, shared: Filter) -> DataFrame:
    """One pass that ends the documents without shared chunks and sets the others apart.

    Rows of kind 0 are results, of kind 1 documents with shared chunks (``keys``; ``home`` is
    the least key, ``salt`` a running number), of kind 2 the texts of the shared chunks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(shared.bits)

    def work(batch):
        encoder, names = worker_encoder(tokenizer), batch.column(0).to_pylist()
        texts = bytes_of(batch.column(1))
        cut = [chunks_of(t, ends) for t, ends in zip(texts, chunk_ends(texts))]
        keys = [[digest(c) for c in chunks] for chunks in cut]
        flags = iter(Filter(sent.value).flags([k for ks in keys for k in ks]).tolist())
        hits = [[k for k in ks if next(flags)] for ks in keys]
        alone = [k for k, h in enumerate(hits) if not h]
        rest = [k for k, h in enumerate(hits) if h]
        store: dict[bytes, bytes] = {}
        for k in rest:
            wanted = set(hits[k])
            store.update((key, c) for key, c in zip(keys[k], cut[k]) if key in wanted)
        n, m, s = len(alone), len(rest), len(store)
        numbers = _result(encoder, encoder.ids_many([texts[k].decode() for k in alone]))
        return [[0] * n + [1] * m + [2] * s,
                [names[k] for k in alone + rest] + [None] * s,
                *(column + [None] * (m + s) for column in numbers),
                [None] * n + [min(hits[k]) for k in rest] + list(store),
                [None] * n + list(range(m)) + [None] * s,
                [None] * n + [sorted(set(hits[k])) for k in rest] + [None] * s,
                [None] * n + [texts[k] for k in rest] + list(store.values())]

    schema = f"kind int, doc_id {id_type(docs)}, {_RESULT}, home binary, salt int, keys array<binary>, body binary"
    return map_rows(narrow(docs, "doc_id", "text"), schema, work)


def id_width(encoder: Encoder) -> str:
    """Type of the ids in the dictionary: two bytes where the vocabulary allows it."""
    def make() -> str:
        return "<u2" if max(encoder.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "<u4"

    return worker_store(f"width:{id(encoder)}", make)


def recast(ids: bytes, given: str, wanted: str) -> bytes:
    return ids if given == wanted else np.frombuffer(ids, given).astype(wanted).tobytes()


_ENTRY = "pieces int, head int, tail int, first int, first_ids int, last int, last_ids int, ids binary"
_ENTRY_FIELDS = [f.split()[0] for f in _ENTRY.split(", ")]


def dictionary(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """Each distinct chunk of ``(home, body)`` encoded once."""
    def work(batch):
        encoder = worker_encoder(tokenizer)
        entries = [make_entry(encoder, c.decode()) for c in batch.column(1).to_pylist()]
        for e in entries:
            e.ids = recast(e.ids, "<u4", id_width(encoder))
        return [batch.column(0), *([getattr(e, f) for e in entries] for f in _ENTRY_FIELDS)]

    return map_rows(chunks.dropDuplicates(["home"]), f"key binary, {_ENTRY}", work)


def _finish(left: pa.Table, right: pa.Table, tokenizer: str, schema: pa.Schema) -> pa.Table:
    encoder = worker_encoder(tokenizer)
    columns = [right.column(f).to_pylist() for f in ["key", *_ENTRY_FIELDS]]
    known = {row[0]: Entry(*row[1:-1], recast(row[-1], id_width(encoder), "<u4")) for row in zip(*columns)}
    texts = left.column("body").to_pylist()
    ids = []
    for text, ends in zip(texts, chunk_ends(texts)):
        chunks = chunks_of(text, ends)
        strings = [c.decode() for c in chunks]
        entries = [known.get(digest(c)) or make_entry(encoder, t) for c, t in zip(chunks, strings)]
        ids.append(splice(encoder, strings, entries))
    return pa.Table.from_arrays([left.column("doc_id"), *map(pa.array, _result(encoder, ids))], schema=schema)


def _buckets(docs: DataFrame) -> DataFrame:
    """The documents with a bucket each: those of one home together, a large home in parts."""
    size = F.sum(F.octet_length("body"))
    total = docs.agg(size).first()[0] or 0
    buckets = max(total // BUCKET_BYTES + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = (docs.groupBy("home").agg(size.alias("bytes")).where(F.col("bytes") > BUCKET_BYTES)
             .select("home", F.ceil(F.col("bytes") / BUCKET_BYTES).alias("parts")))
    part = F.pmod(F.xxhash64("doc_id", "salt"), F.coalesce("parts", F.lit(1)))
    return docs.join(large, "home", "left").withColumn("bucket", F.pmod(F.xxhash64("home", part), F.lit(buckets))).drop("parts")


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, as the tokenizer itself gives.

    Documents without shared chunks are done where they are read.  The others are dealt to
    buckets by their least shared chunk, so copies meet, and each bucket gets the dictionary
    entries that it needs once.  Null and empty texts have no ids; repeated rows and null ids
    are kept; empty tables give empty ones; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    path = new_path(spark, "chunks")
    sorted_out = _sort_out(docs, tokenizer, shared_filter(docs))
    sorted_out.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(sorted_out.schema).parquet(path)
    result = rows.where("kind = 0").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    entries = stage(dictionary(rows.where("kind = 2").select("home", "body"), tokenizer), "dictionary")
    joint = _buckets(rows.where("kind = 1").select("doc_id", "home", "salt", "keys", "body"))
    needed = joint.select(F.col("bucket").alias("target"), F.explode("keys").alias("key")).distinct().join(entries, "key")
    target = to_arrow_schema(result.schema)
    spliced = (joint.select("bucket", "doc_id", "body").groupBy("bucket").cogroup(needed.groupBy("target"))
               .applyInArrow(lambda left, right: _finish(left, right, tokenizer, target), result.schema))
    return result.union(spliced)
