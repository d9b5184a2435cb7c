"""op5: SimHash components of all documents. SQL engines at hand have no XXH64; tests compare with brute force."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.bktree_simhash import near_duplicates
from eventide.llm.common import table


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash_components": op5_simhash_components}
