"""Leakage-safe smoothed target encodings.

A group's value is its winsorised mean pulled toward the mean of its entity, which in turn is
pulled toward the grand mean. Training rows are encoded from all blocks but their own.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.expr import winsorised
from eventide.plans.settle import settle, settle_parts

# Fixed values.
CAP = 3600.0
SMOOTHING = 100.0


@dataclass(frozen=True)
class Spec:
    """Encode ``keys``; the first key is the entity whose mean is the prior."""

    name: str
    keys: tuple[str, ...]

    @property
    def parent(self) -> str:
        return self.keys[0]

    @property
    def outputs(self) -> tuple[str, str]:
        return self.name, f"{self.name}_count"


DEFAULT_SPECS = (
    Spec("te_stand", ("entity", "stand")),
    Spec("te_lane_hour", ("entity", "lane", "hour")),
    Spec("te_operator", ("entity", "operator")),
    Spec("te_dest", ("entity", "dest")),
)


class Cells:
    """Sums of the winsorised target for every key set the specs need, from one scan and one shuffle.

    A single aggregation over grouping sets serves all specs, their parents and the grand total
    (per block, when there are blocks). It is written once; every map is derived from the files.
    """

    def __init__(self, df: DataFrame, specs: Sequence[Spec], target: str, cap: float, block: str | None = None):
        self.block = [block] if block else []
        sets = {tuple(s.keys) for s in specs} | {(s.parent,) for s in specs} | {()}
        self.columns = sorted({k for keys in sets for k in keys}) + self.block
        rows = df.select(*self.columns, winsorised(target, cap).alias("_y"))
        cells = rows.groupingSets([[*keys, *self.block] for keys in sorted(sets)], *self.columns).agg(
            F.grouping_id().alias("gid"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("s"),
            F.count("_y").alias("c"), F.count("*").alias("n"))
        self.table = settle(cells, "cells")

    def of(self, keys: Sequence[str]) -> DataFrame:
        """(keys, block, s, c, n) of one key set; ``grouping_id`` has a bit for each absent column."""
        kept = {*keys, *self.block}
        gid = sum(1 << i for i, c in enumerate(reversed(self.columns)) if c not in kept)
        return self.table.filter(F.col("gid") == gid).select(*keys, *self.block, "s", "c", "n")

    def total(self, keys: Sequence[str]) -> DataFrame:
        """(keys, s, c, n) over all blocks."""
        if not self.block:
            return self.of(keys)
        return self.of(keys).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in ("s", "c", "n")])


def _pulled(s: str, n: str, toward: str, smoothing: float) -> Column:
    return F.expr(f"({s} + {smoothing}D * {toward}) / ({n} + {smoothing}D)")


def _settled_maps(maps: Mapping[Spec, DataFrame], block: Sequence[str]) -> dict[Spec, DataFrame]:
    """Write all maps in one job, a folder each, so that joins with large rows are planned from each map's own size."""
    long = None
    for i, (spec, df) in enumerate(maps.items()):
        part = df.select(F.lit(i).alias("spec"), *spec.keys, *block, "value", F.col("support").cast("int").alias("support"))
        long = part if long is None else long.unionByName(part, allowMissingColumns=True)
    written = settle_parts(long, "spec", "encodings")
    none = long.drop("spec").filter(F.lit(False))
    return {spec: written.get(i, none).select(
        *spec.keys, *block, F.col("value").alias(spec.name), F.col("support").alias(f"{spec.name}_count"))
        for i, spec in enumerate(maps)}


def _prior(cells: Cells, parent: str, smoothing: float) -> DataFrame:
    grand = cells.total([]).select(F.expr("s / c")).scalar()
    return cells.total([parent]).withColumn("grand", grand).select(parent, _pulled("s", "n", "grand", smoothing).alias("prior"), "grand")


def parent_prior(source: DataFrame, parent: str = "entity", target: str = "duration_s",
                 cap: float = CAP, smoothing: float = SMOOTHING) -> DataFrame:
    """(parent, prior, grand): the entity mean smoothed toward the grand mean."""
    return _prior(Cells(source, [Spec("_", (parent,))], target, cap), parent, smoothing)


def fit_maps(source: DataFrame, specs: Sequence[Spec] = DEFAULT_SPECS, target: str = "duration_s",
             cap: float = CAP, smoothing: float = SMOOTHING, cells: Cells | None = None) -> dict[Spec, DataFrame]:
    """Per spec a map (keys, value, support) from exactly these rows, or from their sums."""
    cells = cells or Cells(source, specs, target, cap)
    grand = cells.total([]).select(F.expr("s / c")).scalar()
    maps = {}
    for spec in specs:
        prior = _prior(cells, spec.parent, smoothing).drop("grand")
        maps[spec] = (
            cells.total(spec.keys).join(prior, spec.parent, "left").withColumn("prior", F.coalesce("prior", grand))
            .select(*spec.keys, _pulled("s", "n", "prior", smoothing).alias("value"), F.col("n").alias("support"))
        )
    return _settled_maps(maps, [])


def fit_map(source: DataFrame, spec: Spec, target: str = "duration_s", cap: float = CAP,
            smoothing: float = SMOOTHING) -> DataFrame:
    return fit_maps(source, [spec], target, cap, smoothing)[spec]


def transform(df: DataFrame, maps: Mapping[Spec, DataFrame]) -> DataFrame:
    """Attach encodings; a group the maps have not seen stays null."""
    for spec, table in maps.items():
        df = df.join(table, list(spec.keys), "left")
    return df


def cross_fit_maps(train: DataFrame, block: str, specs: Sequence[Spec] = DEFAULT_SPECS,
                   target: str = "duration_s", cap: float = CAP, smoothing: float = SMOOTHING,
                   cells: Cells | None = None) -> dict[Spec, DataFrame]:
    """Per spec a map keyed by (keys, block) that is fitted on every block but that one.

    Sums over the other blocks are the total less the own block, at group, entity and grand
    level, so one aggregation replaces one refit per block. A group has at most one row per
    block here, which bounds each window. A single block has nothing to learn from and fails.
    """
    cells = cells or Cells(train, specs, target, cap, block)
    if cells.of([]).limit(2).count() < 2:
        raise ValueError("a block has no other rows to encode from")
    grand = _others(cells.of([]), [], ["s", "c"]).select(block, F.expr("try_divide(s_out, c_out) as grand"))
    maps = {}
    for spec in specs:
        parents = _others(cells.of([spec.parent]), [spec.parent], ["s", "n"]).join(grand, block)
        prior = parents.select(spec.parent, block, F.when(
            F.col("n_out") > 0, _pulled("s_out", "n_out", "grand", smoothing)).otherwise(F.col("grand")).alias("prior"))
        maps[spec] = (
            _others(cells.of(spec.keys), spec.keys, ["s", "n"]).filter("n_out > 0").join(prior, [spec.parent, block])
            .select(*spec.keys, block, _pulled("s_out", "n_out", "prior", smoothing).alias("value"), F.col("n_out").alias("support"))
        )
    return _settled_maps(maps, [block])


def _others(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``<value>_out``: the total over the group's blocks less the row's own block."""
    group = ", ".join(keys) if keys else "0"
    return df.selectExpr("*", *[f"sum({v}) over (partition by {group}) - {v} as {v}_out" for v in values])


def cross_fit(train: DataFrame, block: str, specs: Sequence[Spec] = DEFAULT_SPECS, **how) -> DataFrame:
    """Training rows with leave-one-block-out encodings."""
    out = train
    for spec, table in cross_fit_maps(train, block, specs, **how).items():
        out = out.join(table, [*spec.keys, block], "left")
    return out


def encode_split(fit: DataFrame, others: Sequence[DataFrame], block: str,
                 specs: Sequence[Spec] = DEFAULT_SPECS, target: str = "duration_s", cap: float = CAP,
                 smoothing: float = SMOOTHING) -> tuple[DataFrame, list[DataFrame]]:
    """Cross-fit the training rows; encode every other frame from maps of all training rows.

    The training rows are summed once, per block, for both.
    """
    how = {"target": target, "cap": cap, "smoothing": smoothing, "cells": Cells(fit, specs, target, cap, block)}
    maps = fit_maps(fit, specs, **how)
    return cross_fit(fit, block, specs, **how), [transform(d, maps) for d in others]
