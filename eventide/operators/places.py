"""The place of every row in one order of the whole table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.plans.settle import settle


def with_place(df: DataFrame, keys: Sequence[str | Column], name: str = "place") -> DataFrame:
    """Add the row's number in the order of ``keys``, from 1. The keys must tell all rows apart.

    Rows are numbered inside ranges of the order, which hold about as many rows each, and the
    ranges are shifted by the rows before them: no task sees more than a range. The ranges are
    written, so that they stay as they are when a task is run again.
    """
    ranges = settle(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_p").orderBy(*keys)
    numbered = ranges.withColumn("_r", F.row_number().over(inside)).join(starts, "_p")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_r")).alias(name))
