"""op4: long repeats out of all documents. Tests compare with a brute-force version."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import table
from eventide.llm.interval_dedup import remove_repeats


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then kept_text: what stays, with U+FFFD where a cut left a part of a character."""
    found = remove_repeats(table(spark, sf_dir, "documents"), with_text=True)
    return found.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


QUERIES = {"op4_repeat_removal": op4_repeat_removal}
