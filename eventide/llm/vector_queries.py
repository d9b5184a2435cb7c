"""op2 and op8 over all embeddings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import table
from eventide.llm.int8_tiles import near_vectors
from eventide.llm.nn_descent import nearest


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_nearest_neighbours": op2_nearest_neighbours, "op8_embedding_near_dups": op8_embedding_near_dups}
