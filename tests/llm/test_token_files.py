"""Round trips of the token files."""

import io
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from ebbtide.llm.token_files import FileReader, FileWriter, filesystem, read_token_files, token_file_digests, write_token_files
from ebbtide.sources.staging import new_path


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def plain(rows, tokenizer):
    t, out, start = Tokenizer.from_file(tokenizer), [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_given_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, token_file_digests(docs, tokenizer).collect()))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], tokenizer)


def test_edges(make_docs, spark, tokenizer):
    rows = [(5, "b c"), (None, "x"), (2, None), (2, "a"), (9, ""), (5, "b c"), (-3, "word " * 20000)]
    got = token_file_digests(make_docs(rows, extra=["start", "file"]), tokenizer).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == plain(rows, tokenizer)
    assert token_file_digests(make_docs([]), tokenizer).count() == 0


def test_only_requested_frames_are_read(make_docs, spark, tokenizer):
    folder = new_path(spark, "token-files")
    manifest = write_token_files(make_docs([(i, f"text number {i}") for i in range(50)]), tokenizer, folder)
    assert manifest.agg({"documents": "sum"}).first()[0] == 50
    got = read_token_files(spark, folder, doc_ids=[7, 31, 999]).collect()
    t = Tokenizer.from_file(tokenizer)
    assert {r.doc_id: r.ids for r in got} == {i: [*t.encode(f"text number {i}").ids, 0] for i in (7, 31)}


def test_format_and_damage():
    sink = io.BytesIO()
    writer = FileWriter(sink, 2)
    for k in range(5):
        writer.add(k if k != 3 else None, np.arange(k * 10, dtype="<u4"))
    writer.close()
    raw = sink.getvalue()
    reader = FileReader(Source(raw))
    assert reader.ids == [0, 1, 2, None, 4]
    assert [x.tolist() for x in reader.documents()] == [list(range(k * 10)) for k in range(5)]
    assert reader.document(4).tolist() == list(range(40)) and reader.starts.tolist() == [0, 0, 10, 30, 60]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(np.arange(k * 10, dtype="<u2").tobytes() for k in range(5))
    broken = bytearray(raw)
    broken[int(reader.offsets[4]) + int(reader.entries["packed"][4]) - 2] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        FileReader(Source(bytes(broken))).document(4)


def test_hadoop_style_path(tmp_path):
    assert filesystem(f"file:{tmp_path}")[1] == str(tmp_path) == filesystem(f"file://{tmp_path}")[1]
