"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return the
columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.bktree_simhash import drop_near_duplicates
from eventide.llm.bpe_automaton import encode_documents
from eventide.llm.bpe_queries import vocabulary_path
from eventide.llm.common import settle, table
from eventide.llm.crf_language import UNKNOWN, fit, identify, training_fold
from eventide.llm.mixing import mixed_documents
from eventide.llm.secret_scan import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of any language or mix of languages: texts that are null or without letters go. Without labels to learn from, all stay."""
    columns = docs.columns
    model = fit(docs.filter(~training_fold()).select("text", "lang"))
    if not model.languages:
        return docs
    named = identify(docs, model, tuple(columns), label="_lang_pred", score="_lang_score")
    return named.filter(F.col("_lang_pred") != UNKNOWN).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets in their texts replaced."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them: not at all, once or twice."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids: the token ids of every document of the mix."""
    return encode_documents(docs, vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
