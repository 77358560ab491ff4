"""A corpus pipeline: quality rules, line dedup, near-duplicate documents, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, read
from Parquet.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fuzzloom.llm import byte_bpe, cube_mix, line_windows, rule_ledger, shingle_forest
from fuzzloom.llm.common import documents, done_with
from fuzzloom.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    return rule_ledger.keep_passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents of nothing else go."""
    return line_windows.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return shingle_forest.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return cube_mix.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix."""
    import public_tokenizers

    return byte_bpe.round_trip_query(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mix", mix), ("byte BPE", tokens)]

#: Near duplicates and the mix are not SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's own tables are deleted when it is written."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = done_with(spark, lambda: stage(spark, docs, sf_dir)) if k < len(STAGES) - 1 else stage(spark, docs, sf_dir)  # noqa: B023
    return docs
