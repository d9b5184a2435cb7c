"""op10: the language of all documents. SQL has no such model; tests measure held-out accuracy."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import table
from eventide.llm.crf_language import fit, identify, training_fold


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~training_fold()).select("text", "lang"))
    return identify(docs.withColumn("held_out", training_fold()), model, ("doc_id", "held_out")).withColumnRenamed("lang_score", "score").select(
        "doc_id", "held_out", "lang_pred", F.col("score"))


QUERIES = {"op10_language_id": op10_language_id}
