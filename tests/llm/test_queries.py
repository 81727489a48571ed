"""Every registered query returns a row per document with the agreed columns."""

import pytest

import __spark_entry__ as contract
from ebbtide.llm.queries import QUERIES

COLUMNS = {
    1: "doc_id held_out:boolean lang_pred:string score:double",
    2: "doc_id start:bigint n_tokens:bigint ids_crc32:bigint",
    3: "doc_id n_tokens:bigint ids_sha256:string decoded_sha256:string",
    4: "doc_id n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    5: "doc_id held_out:boolean score:double predicted:int",
    6: "doc_id fingerprint:string component_id:bigint",
    7: "doc_id n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    8: "doc_id n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    9: "doc_id n_bytes:bigint n_tokens:bigint over_limit:boolean",
    10: "doc_id n_words:bigint n_removed:bigint kept_sha256:string",
    11: "word:string form:string root:string n:bigint n_near:bigint form_n:bigint",
    12: "doc_id piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    13: "doc_id n_a:bigint n_b:bigint n_groups:bigint n_links:bigint n_best:bigint count_sum:bigint groups_sha256:string",
}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_columns_and_rows(key, spark, sf_dir):
    frame = QUERIES[key](spark, sf_dir)
    kinds = dict(frame.dtypes)
    for column in COLUMNS[int(key[2:].split("_")[0])].split():
        name, _, kind = column.partition(":")
        assert kinds[name] == (kind or "bigint")
    if key == "op11_spelling":
        return
    rows = frame.where("piece = 0") if key == "op12_packing" else frame
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    given = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(ids) == sorted(given)


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
