"""Stable integer codes for categories shared by several tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.plans.settle import settle


def in_ranges(values: DataFrame) -> DataFrame:
    """Distinct (column, value) rows with ``_p``, the number of the range they lie in. Written, so that the ranges stay as they are.

    Ranges are cut by a sample of the values themselves: they hold about as many rows each, however alike the values begin.
    """
    return settle(values.repartitionByRange("column", "value").withColumn("_p", F.spark_partition_id()), "ranges")


def code_dimension(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """(column, value, code): code is the rank of the value among all tables, from 0.

    All columns are handled in one pass. Ranks are taken inside ranges of values and
    shifted by the number of values in earlier ranges, so a large dictionary is not sorted in
    one task. Nulls have no code.
    """
    pairs = None
    for t in tables:
        p = t.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
        ]))).filter(F.col("value").isNotNull()).distinct()
        pairs = p if pairs is None else pairs.unionByName(p)
    values = in_ranges(pairs.distinct())
    before = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = (
        values.groupBy("column", "_p").agg(F.count("*").alias("_n"))
        .select("column", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("column", "_p").orderBy("value")
    return (
        values.withColumn("_r", F.row_number().over(inside))
        .join(starts, ["column", "_p"])
        .select("column", "value", (F.col("_start") + F.col("_r") - 1).cast("int").alias("code"))
    )


def code_sizes(dimension: DataFrame) -> DataFrame:
    return dimension.groupBy("column").agg(F.count("*").alias("categories"))


def attach_codes(df: DataFrame, dimension: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its code; unknown and null values stay null.

    Pass a settled dimension so that each join can be planned from its real size.
    """
    out = df
    for c in columns:
        codes = dimension.filter(F.col("column") == c).select(
            F.col("value").alias(c), F.col("code").alias(f"_code_{c}"))
        out = out.withColumn(c, F.col(c).cast("string")).join(codes, c, "left")
    keep = [F.col(f"_code_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return out.select(*keep)


def codes_of(dimension: DataFrame, column: str) -> DataFrame:
    """The stored mapping of one column, so nothing has to be derived from the data again."""
    return dimension.filter(F.col("column") == column).select("value", "code")
