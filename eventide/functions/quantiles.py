"""Exact quantiles that never hold a whole group in memory."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.plans.settle import settle

NEAREST, LINEAR = "nearest", "linear"


CELLS, FITS = 1024, 100_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, tuple[float, str]], weight: str | None = None,
                    total: str | None = None, fits: int = FITS) -> DataFrame:
    """One row per group with a column per ``name -> (q, method)``, and the group's rows as ``total`` if named.

    ``nearest`` takes the value at rank ``round((n - 1) * q)``, ``linear`` interpolates between
    the two ranks around ``(n - 1) * q``; a median is linear at 0.5. ``weight`` counts a row that often. Nulls take no part; a group of nulls gives
    no row. Equal values are counted before the shuffle; then the cell of values around each wanted rank is narrowed, see ``narrowed``, and only
    cells of up to ``fits`` distinct values are sorted, whatever the values' scale.
    """
    keys = list(keys)
    group = F.struct(*keys) if keys else F.struct(F.lit(1))  # as a struct, a null key equals a null key
    hist = settle(df.filter(F.col(value).isNotNull()).groupBy(group.alias("_g"), F.col(value).alias("_v")).agg(
        F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("_n")), "histogram")
    return quantiles_of_counts(hist, keys, wanted, total, fits)


def quantiles_of_counts(hist: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[float, str]], total: str | None = None,
                        fits: int = FITS) -> DataFrame:
    """The same from counts that are made already: (_g, _v, _n), one row per group (a struct of ``keys``) and value, ``_n`` over zero."""
    totals = hist.groupBy("_g").agg(F.sum("_n").alias("_total"))
    ranks = {name: _ranks(F.col("_total"), q, method) for name, (q, method) in wanted.items()}
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(side).alias("_side"), r[side].cast("long").alias("_rank"))
                      for name, r in ranks.items() for side in (0, 1)])
    live, targets = narrowed(hist, totals.select("_g", "_total", F.inline(asked)), fits)
    inside = Window.partitionBy("_g", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = live.withColumn("_upto", F.sum("_n").over(inside))
    found = placed.join(targets, ["_g", "_cell"]).filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
    out = []
    for name, (_, _, part) in ranks.items():
        low, high = (F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col("_v"))) for side in (0, 1))
        low, high = (low, high) if part is None else (low.cast("double"), high.cast("double"))
        out.append((low if part is None else low + (high - low) * F.max(part)).alias(name))
    if total:
        out.append(F.max("_total").alias(total))
    return found.groupBy("_g").agg(*out).select(*[F.col(f"_g.{k}").alias(k) for k in keys], *wanted, *([total] if total else []))


def narrowed(hist: DataFrame, targets: DataFrame, fits: int = FITS) -> tuple[DataFrame, DataFrame]:
    """(values, targets) in cells of at most ``fits`` distinct values, from (_g, _v, _n) and (_g, _rank, ...).

    A cell is cut into ``CELLS`` equal parts between its own least and largest value, the part that holds a wanted rank becomes the new
    cell, and so on while some cell is too large. Each round is one aggregation of what is left and is written; the driver
    sees one number. Ranks become those within the cell. Infinities and NaN lie in parts of their own; a cell of one double fits.
    """
    live, targets = hist.withColumn("_cell", F.lit("")), targets.withColumn("_cell", F.lit(""))
    x = F.col("_v").cast("double")
    usual = F.when((x > float("-inf")) & (x < float("inf")), x)
    while True:
        extent = live.groupBy("_g", "_cell").agg(F.min(usual).alias("_lo"), F.max(usual).alias("_hi"), F.count(F.lit(1)).alias("_d"))
        extent = settle(extent.filter((F.col("_d") > fits) & (F.col("_hi") > F.col("_lo"))), "extent")
        if extent.isEmpty():
            return live, targets
        span = F.col("_hi") / 2 - F.col("_lo") / 2
        part = F.least(F.floor((x / 2 - F.col("_lo") / 2) / span * CELLS), F.lit(CELLS - 1))
        part = F.when(F.isnan(x) | (x == float("inf")), F.when(F.isnan(x), CELLS + 1).otherwise(CELLS)).when(x == float("-inf"), -1).otherwise(part)
        cut = live.join(extent, ["_g", "_cell"], "left").withColumn("_part", F.when(F.col("_d").isNull(), 0).otherwise(part)).drop("_lo", "_hi", "_d")
        before = Window.partitionBy("_g", "_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS + 3 rows
        counts = cut.groupBy("_g", "_cell", "_part").agg(F.sum("_n").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        named = F.concat_ws("/", F.col("_cell"), F.col("_part").cast("string"))
        held = targets.join(counts, ["_g", "_cell"]).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
        held = held.withColumns({"_rank": F.col("_rank") - F.col("_before"), "_cell": named}).select(*targets.columns)
        targets = settle(held, "targets")
        live = settle(cut.withColumn("_cell", named).drop("_part").join(targets.select("_g", "_cell").distinct(), ["_g", "_cell"], "left_semi"), "cells")


def _ranks(total: Column, q: float, method: str) -> tuple[Column, Column, Column | None]:
    position = (total - 1).cast("double") * F.lit(float(q))
    if method == NEAREST:
        r = F.round(position).cast("long")
        return r, r, None
    lo = F.floor(position)
    return lo, F.least(lo + 1, total - 1), position - lo


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: (0.5, LINEAR)})


def with_quantiles(groups: DataFrame, rows: DataFrame, keys: Sequence[str], value: str,
                   wanted: Mapping[str, tuple[float, str]]) -> DataFrame:
    """Add the quantiles of ``rows`` to a table that has one row per group; null is a group too."""
    q = exact_quantiles(rows, keys, value, wanted).withColumnsRenamed({k: f"_q_{k}" for k in keys})
    same = [groups[k].eqNullSafe(q[f"_q_{k}"]) for k in keys]
    return groups.join(q, same, "left").drop(*[f"_q_{k}" for k in keys])
