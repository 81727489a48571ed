"""The operators as registered queries: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import block_dedup, suffix_dedup
from ebbtide.llm.alignment import align_tokenizers
from ebbtide.llm.bpe import encode_decode
from ebbtide.llm.common import table
from ebbtide.llm.decontaminate import contamination
from ebbtide.llm.host_rules import apply_rules
from ebbtide.llm.language import identify, learn
from ebbtide.llm.oracles import ORACLES  # noqa: F401  (the contract reads both from here)
from ebbtide.llm.packing import pack
from ebbtide.llm.quality_model import score_quality
from ebbtide.llm.simhash import near_duplicates
from ebbtide.llm.spelling import spelling_variants
from ebbtide.llm.token_counts import count_tokens
from ebbtide.llm.token_files import token_file_digests


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, "crc32(cast(doc_id AS string)) % 3 <> 1")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identify(docs, model).withColumn("held_out", held_out)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                           "crc32(cast(doc_id AS string)) % 4 <> 2")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(*columns)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("host", "host_rate")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_token_files": op2_token_files,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_host_rules": op8_host_rules,
    "op9_token_counts": op9_token_counts,
    "op10_block_dedup": op10_block_dedup,
    "op11_spelling": op11_spelling,
    "op12_packing": op12_packing,
    "op13_alignment": op13_alignment,
}
