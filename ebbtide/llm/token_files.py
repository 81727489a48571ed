"""Token-id files: independent zstandard frames with a seek table and per-frame checksums.

One file is a range of documents in ascending ``doc_id`` order.  Each document is one
zstandard frame, so a reader fetches and decompresses only the documents it is asked for.
After them comes a skippable frame with the directory (format data and document ids) and,
last, the seek table of the public seekable format: per frame its compressed size, its
decompressed size and the low 32 bits of the XXH64 of its content.

Files go to the shared folder of the cluster through ``pyarrow.fs``; a task writes under a
name of its own attempt, and only the files in the manifest count, so a lost executor or a
repeated task leaves nothing half-written behind a valid name.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.blobs import byte_slices
from ebbtide.llm.common import narrow
from ebbtide.llm.words import SLICE_BYTES, worker_ids
from ebbtide.sources.staging import new_path

# Fixed values of the public zstandard seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
DIRECTORY_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_FOOTER, _FOOTER_BYTES = "<IBI", 9
_HEADER, _HEADER_BYTES = "<II", 8

END_ID = 0
_READ_AT_ONCE = 4 << 20


def filesystem(path: str):
    """``pyarrow`` file system and inner path of a Hadoop-style path."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FileWriter:
    """Write documents, in the given order, to one file."""

    def __init__(self, sink, width: int):
        import zstandard

        self.sink, self.width = sink, width
        self.packer = zstandard.ZstdCompressor(level=3)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        content = ids.astype(f"<u{self.width}").tobytes()
        frame = self.packer.compress(content)
        self.sink.write(frame)
        self.entries.append((len(frame), len(content), _checksum(content)))
        self.ids.append(doc_id)
        self.tokens += len(ids)

    def close(self) -> None:
        missing = [k for k, d in enumerate(self.ids) if d is None]
        about = json.dumps({"width": self.width, "documents": len(self.ids), "null_ids": missing}).encode()
        numbers = np.array([d or 0 for d in self.ids], dtype="<i8").tobytes()
        body = struct.pack("<I", len(about)) + about + self.packer.compress(numbers)
        self.sink.write(struct.pack(_HEADER, DIRECTORY_MAGIC, len(body)) + body)
        self.entries.append((_HEADER_BYTES + len(body), 0, _checksum(b"")))
        table = np.array(self.entries, dtype=_ENTRY).tobytes()
        footer = struct.pack(_FOOTER, len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack(_HEADER, SEEK_TABLE_MAGIC, len(table) + len(footer)) + table + footer)


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        total = source.size()
        count, flag, magic = struct.unpack(_FOOTER, self._at(total - _FOOTER_BYTES, _FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        table = total - _FOOTER_BYTES - count * _ENTRY.itemsize
        if struct.unpack(_HEADER, self._at(table - _HEADER_BYTES, _HEADER_BYTES))[0] != SEEK_TABLE_MAGIC:
            raise ValueError("the seek table has no header")
        entries = np.frombuffer(self._at(table, count * _ENTRY.itemsize), _ENTRY)
        offsets = np.concatenate([[0], np.cumsum(entries["packed"], dtype=np.int64)])
        body = self._at(int(offsets[-2]), int(entries["packed"][-1]))[_HEADER_BYTES:]
        length = struct.unpack("<I", body[:4])[0]
        about = json.loads(body[4:4 + length])
        self.entries, self.offsets, self.width = entries[:-1], offsets[:-1], about["width"]
        numbers = self.unpacker.decompress(body[4 + length:], max_output_size=8 * about["documents"] + 1)
        self.ids: list[int | None] = np.frombuffer(numbers, "<i8").tolist()
        for k in about["null_ids"]:
            self.ids[k] = None
        self.lengths = self.entries["size"].astype(np.int64) // self.width
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _open(self, k: int, frame: bytes) -> np.ndarray:
        content = self.unpacker.decompress(frame, max_output_size=int(self.entries["size"][k]))
        if len(content) != self.entries["size"][k] or _checksum(content) != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; no other frame is read."""
        return self._open(k, self._at(int(self.offsets[k]), int(self.entries["packed"][k])))

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of all documents, read in runs of neighbouring frames."""
        k, n = 0, len(self.entries)
        while k < n:
            stop = max(int(np.searchsorted(self.offsets, self.offsets[k] + _READ_AT_ONCE, "right")) - 1, k + 1)
            stop = min(stop, n)
            run = self._at(int(self.offsets[k]), int(self.offsets[stop] - self.offsets[k]))
            for j in range(k, stop):
                a = int(self.offsets[j] - self.offsets[k])
                yield self._open(j, run[a:a + int(self.entries["packed"][j])])
            k = stop


def _write_partition(batches: Iterable[pa.RecordBatch], folder: str, tokenizer: str, end_id: int):
    """One file of a sorted partition; yields its manifest row."""
    from pyspark import TaskContext

    table = worker_ids(tokenizer)
    width = 2 if len(table.encoder.after_space) <= 1 << 16 else 4
    writer = sink = None
    for part in byte_slices(iter(batches), 1, SLICE_BYTES):
        if not part.num_rows:
            continue
        if writer is None:
            store, inner = filesystem(folder)
            shard = TaskContext.get().partitionId()
            name = f"shard-{shard:06d}-{uuid.uuid4().hex}.zst"
            sink = store.open_output_stream(f"{inner}/{name}", compression=None)
            writer = FileWriter(sink, width)
        ids, ends = table.encode(part.column(1))
        for doc_id, a, b in zip(part.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
            writer.add(doc_id, np.append(ids[a:b], np.uint32(end_id)))
    if writer is not None:
        writer.close()
        sink.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(writer.ids)], pa.int64()),
             pa.array([writer.tokens], pa.int64())], names=["shard", "file", "documents", "tokens"])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode every row and write the files; returns the manifest, also kept as Parquet.

    The manifest has a row per file: ``shard, file, documents, tokens, start`` (tokens before
    it).  Documents are ordered by ``doc_id`` (null first, equal ids by text) and dealt to files
    by ranges, so no task holds more than its range.  A null text is empty and has the end id
    only.  Other columns are not read.
    """
    spark = docs.sparkSession
    store, inner = filesystem(folder)
    store.create_dir(f"{inner}/files", recursive=True)
    ordered = (narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    written = ordered.mapInArrow(lambda batches: _write_partition(batches, f"{folder}/files", tokenizer, end_id),
                                 "shard int, file string, documents long, tokens long")
    rows = sorted(tuple(r) for r in written.collect())  # one row per file
    starts = np.cumsum([0, *[r[3] for r in rows]]).tolist()
    manifest = spark.createDataFrame([(*r, s) for r, s in zip(rows, starts)],
                                     "shard int, file string, documents long, tokens long, start long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _read_files(batches, folder: str, wanted: set[int] | None, digest: bool):
    store, inner = filesystem(folder)
    for batch in batches:
        for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with store.open_input_file(f"{inner}/{name}") as source:
                reader = FileReader(source)
                chosen = range(len(reader.ids)) if wanted is None else [k for k, d in enumerate(reader.ids) if d in wanted]
                contents = reader.documents() if wanted is None else map(reader.document, chosen)
                rows: list[tuple] = []
                for k, ids in zip(chosen, contents):
                    payload = zlib.crc32(ids.tobytes()) if digest else ids.astype(np.int64)
                    rows.append((reader.ids[k], base + int(reader.starts[k]), len(ids), payload))
                    if len(rows) >= 512:
                        yield _rows(rows, digest)
                        rows = []
                if rows:
                    yield _rows(rows, digest)


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def read_token_files(spark: SparkSession, folder: str, doc_ids: Iterable[int] | None = None, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (``digest``: ``ids_crc32``) from the files.

    With ``doc_ids`` only the frames of those documents are read and decompressed.
    """
    wanted = None if doc_ids is None else set(doc_ids)
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = max(manifest.count(), 1)
    tasks = manifest.select("file", "start").repartition(files)  # a fixed number: the rows are tiny, the files are not
    last = "ids_crc32 long" if digest else "ids array<long>"
    return tasks.mapInArrow(
        lambda batches: _read_files(batches, f"{folder}/files", wanted, digest),
        f"doc_id long, start long, n_tokens long, {last}")


def token_file_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of all rows to the shared folder and read their digests back.

    An empty table gives no file and an empty result; repeated rows give repeated documents.
    """
    folder = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, folder)
    return read_token_files(docs.sparkSession, folder, digest=True)
