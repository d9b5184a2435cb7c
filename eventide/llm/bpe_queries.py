"""Queries on tokens: op3 encodes and decodes, op9 counts. SQL has no byte-pair merging; tests compare with the library."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.bpe_automaton import digest_documents
from eventide.llm.common import table
from eventide.llm.token_counts import count_documents

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"), vocabulary_path(), LIMIT)


QUERIES = {"op3_bpe_encode_decode": op3_bpe_encode_decode, "op9_token_counts": op9_token_counts}
