"""op7: language-model scores of all documents. The base's counts compare with brute force; the model with held-out base scores."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.attention_lm import score_documents
from eventide.llm.bpe_queries import vocabulary_path
from eventide.llm.common import fold_of, table

RANKS = "byte_bpe_50k.tiktoken"


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), vocabulary_path(RANKS), fold_of("doc_id", 7) != F.lit(2))


QUERIES = {"op7_lm_scores": op7_lm_scores}
