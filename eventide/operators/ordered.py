"""Ordered target statistics: a category's mean target over the rows before this one in a seeded order, drawn towards the prior.

A row never meets its own target, nor one that comes later. Running totals use the bucket-and-carry primitive of ``prefix``, so a
category that holds a third of all rows is spread over as many tasks as it has buckets.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.prefix import running_totals
from eventide.plans.settle import settle

STRENGTH = 1.0
_PLACE_BITS = 60


def place_of(id_col: str, seed: int) -> Column:
    """A row's place in the seeded order: the first 15 hex digits of md5 of ``id:seed``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")


def statistic(total: Column, n: Column, prior: float, strength: float = STRENGTH) -> Column:
    return (total + F.lit(strength * prior)) / (n + F.lit(strength))


def ordered_statistics(fit: DataFrame, columns: Sequence[str], target: str, prior: float, id_col: str = "id", seed: int = 0,
                       strength: float = STRENGTH, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """(id, os_<column>...) for the rows with a target. Null is a category too; ids must be unique."""
    width = max(1, (1 << _PLACE_BITS) * rows_per_bucket // max(1, fit.count()))
    points = fit.filter(F.col(target).isNotNull()).select(F.col(id_col).alias("_id"), place_of(id_col, seed).alias("_place"), F.col(target).alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("_c"), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("_v")) for k, c in enumerate(columns)])))
    points = points.select("_id", "_place", "_c", "_v", F.col("_y").alias("_own"), F.col("_y").alias("_total"), F.lit(1).cast("long").alias("_n"))
    upto = running_totals(points, ["_c", "_v"], ["_place", "_id"], ["_total", "_n"], f"_place div {width}")
    mine = upto.withColumn("_s", statistic(F.col("_total") - F.col("_own"), F.col("_n") - 1, prior, strength))
    return mine.groupBy(F.col("_id").alias(id_col)).agg(*[F.max(F.when(F.col("_c") == k, F.col("_s"))).alias(f"os_{c}") for k, c in enumerate(columns)])


def fit_statistics(fit: DataFrame, columns: Sequence[str], target: str, prior: float, strength: float = STRENGTH) -> DataFrame:
    """(column, value, statistic) over all fit rows, for rows that took no part in the fit. Written."""
    values = fit.filter(F.col(target).isNotNull()).select(F.col(target).alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    made = values.groupBy("column", "value").agg(F.sum("_y").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return settle(made.select("column", "value", statistic(F.col("_t"), F.col("_n"), prior, strength).alias("statistic")), "statistics")


def apply_statistics(df: DataFrame, fitted: DataFrame, columns: Sequence[str], prior: float) -> DataFrame:
    """Adds os_<column>; values that the fit rows lack get the prior. Each join is planned from the written size."""
    for c in columns:
        known = fitted.filter(F.col("column") == c).select(F.col("value").alias("_v"), F.col("statistic").alias(f"os_{c}"))
        df = df.join(known, df[c].cast("string").eqNullSafe(known["_v"]), "left").drop("_v").withColumn(f"os_{c}", F.coalesce(f"os_{c}", F.lit(prior)))
    return df
