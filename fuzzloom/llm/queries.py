"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fuzzloom.llm.common import documents, spread

#: Where the public tokenizers' files are; a folder, or None for the installed package.
TOKENIZERS: str | None = None


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.transport_stream import media_digest

    return media_digest(spread(documents(spark, sf_dir)))


def op4_shingle_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.shingle_forest import link_documents

    return link_documents(spread(documents(spark, sf_dir)))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.rule_ledger import verdicts

    return verdicts(spread(documents(spark, sf_dir)))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fuzzloom.llm.byte_bpe import round_trip_query

    return round_trip_query(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.token_files import token_digest

    return token_digest(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.secret_scan import secret_spans

    return secret_spans(spread(documents(spark, sf_dir)))


def op3_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.hash_ring import shard_documents

    return shard_documents(documents(spark, sf_dir))


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.line_windows import dedup_lines

    return dedup_lines(documents(spark, sf_dir))


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.cube_mix import mix_documents

    return mix_documents(documents(spark, sf_dir))


def op10_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.paragraph_bands import digest

    return digest(spread(documents(spark, sf_dir)))


def op11_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.capture_index import capture_digest

    return capture_digest(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.hard_negatives import mine_embeddings

    return mine_embeddings(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fuzzloom.llm.block_max import search

    return search(spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from fuzzloom.llm import block_max, capture_index, hard_negatives, line_windows, rule_ledger

    return {
        "op5_rule_ledger": rule_ledger.ORACLE,
        "op8_line_windows": line_windows.ORACLE,
        "op11_capture_index": capture_index.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
        "op13_block_max": block_max.ORACLE,
    }
