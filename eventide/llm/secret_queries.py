"""op1: secrets in all documents. The battery's tests compare with a brute-force version."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import table
from eventide.llm.secret_scan import KINDS, names, scan


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(k: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *(count(k) for k in range(len(KINDS))), F.sha2(names(F.col("spans"), base_only=True).cast("binary"), 256).alias("base_sha256"),
                        names(F.col("spans")).alias("spans"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
