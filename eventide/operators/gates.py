"""Acceptance gates: one verdict row per comparison, to be persisted and read by the next step."""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.expr import finite
from eventide.operators.bootstrap import REPLICATES, paired_bootstrap
from eventide.operators.metrics import largest_row_share, rmse, squared_error
from eventide.operators.overlay import Trigger, apply_overlay

# Fixed values.
MIN_WIN_RATE = 0.95
MAX_ROW_SHARE = 50.0
KEEP_REPLICATES = 1000


def _arms(df: DataFrame, trigger: Trigger, line: DataFrame, floor: float | None) -> DataFrame:
    out = apply_overlay(df, trigger, ["base", "cand"], line, floor=floor, required=True)
    y = trigger.target
    return (
        out.withColumn("se_base", squared_error("base", y)).withColumn("se_cand", squared_error("cand", y))
        .withColumn("se_base_overlaid", squared_error("base_overlaid", y))
        .withColumn("se_cand_overlaid", squared_error("cand_overlaid", y))
    )


def invariance(may_change: Column | None) -> list[Column]:
    """Aggregates over rows outside the declared scope: how many, how many changed, by how much.

    A value that is missing on one side only has changed.
    """
    outside = F.lit(False) if may_change is None else ~F.coalesce(may_change, F.lit(False))
    delta = F.abs(F.col("cand") - F.col("base"))
    return [F.count_if(outside).alias("rows_outside"),
            F.count_if(outside & ~F.col("cand").eqNullSafe(F.col("base"))).alias("changed_outside"),
            F.coalesce(F.max(F.when(outside, delta)), F.lit(0.0)).alias("max_change_outside")]


def unusable(truth: str, *predictions: str) -> Column:
    """How many rows lack a finite truth or prediction. A mean would skip them and compare different rows."""
    return F.count_if(~F.coalesce(reduce(and_, (finite(c) for c in (truth, *predictions))), F.lit(False))).alias("unusable")


def overlay_gate(df: DataFrame, trigger: Trigger, line: DataFrame, may_change: Column | None, label: str,
                 policy: str = "both", min_win_rate: float = MIN_WIN_RATE,
                 max_row_share: float = MAX_ROW_SHARE, replicates: int = REPLICATES,
                 floor: float | None = None, id_col: str = "id") -> DataFrame:
    """Compare ``cand`` with ``base`` raw and under one common overlay.

    Passes when both point errors improve, the bootstrap is confident (``policy``: "both" arms,
    or "shipping", the overlaid arm only), rows outside the scope are untouched, no single row
    owns more than ``max_row_share`` percent of the gain, and no row lacks a finite value.
    """
    if policy not in ("both", "shipping"):
        raise ValueError(f"unknown policy {policy!r}")
    if not 0.0 < max_row_share <= 100.0 or not 0.0 <= min_win_rate <= 1.0:
        raise ValueError("max_row_share must be in (0, 100] and min_win_rate in [0, 1]")
    arms = _arms(df, trigger, line, floor).withColumn("label", F.lit(label))
    y = trigger.target
    point = arms.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("touched").alias("touched"),
        rmse("base", y).alias("base_raw"), rmse("cand", y).alias("cand_raw"),
        rmse("base_overlaid", y).alias("base_overlaid"), rmse("cand_overlaid", y).alias("cand_overlaid"),
        *invariance(may_change), unusable(y, "base", "cand", "base_overlaid", "cand_overlaid"),
        largest_row_share(F.col("se_base_overlaid") - F.col("se_cand_overlaid")).alias("largest_share"))
    boot = paired_bootstrap(arms, id_col, {"raw": ("se_base", "se_cand"),
                                           "overlaid": ("se_base_overlaid", "se_cand_overlaid")},
                            ["label"], replicates)
    confident = F.col("confident_overlaid")
    if policy == "both":
        confident = confident & F.col("confident_raw")
    return (
        point.join(boot, "label")
        .withColumn("improves_raw", F.col("cand_raw") < F.col("base_raw"))
        .withColumn("improves_overlaid", F.col("cand_overlaid") < F.col("base_overlaid"))
        .withColumn("confident_raw", F.col("win_raw") >= min_win_rate)
        .withColumn("confident_overlaid", F.col("win_overlaid") >= min_win_rate)
        .withColumn("unchanged", F.col("changed_outside") == 0)
        .withColumn("broad", F.coalesce(F.col("largest_share") <= max_row_share, F.lit(False)))
        .withColumn("passed", F.col("improves_raw") & F.col("improves_overlaid") & confident
                    & F.col("unchanged") & F.col("broad") & (F.col("unusable") == 0))
    )


def plain_gate(df: DataFrame, label: str, truth: str = "duration_s", min_win_rate: float = MIN_WIN_RATE,
               replicates: int = REPLICATES, id_col: str = "id") -> DataFrame:
    """Point improvement and bootstrap over rows that all have finite values; the largest-row share is reported, not judged."""
    arms = (
        df.withColumn("label", F.lit(label)).withColumn("se_base", squared_error("base", truth))
        .withColumn("se_cand", squared_error("cand", truth))
    )
    point = arms.groupBy("label").agg(
        F.count("*").alias("n"), rmse("base", truth).alias("base_raw"), rmse("cand", truth).alias("cand_raw"),
        largest_row_share(F.col("se_base") - F.col("se_cand")).alias("largest_share"), unusable(truth, "base", "cand"))
    boot = paired_bootstrap(arms, id_col, {"raw": ("se_base", "se_cand")}, ["label"], replicates)
    return (
        point.join(boot, "label").withColumn("improves_raw", F.col("cand_raw") < F.col("base_raw"))
        .withColumn("confident_raw", F.col("win_raw") >= min_win_rate)
        .withColumn("passed", F.col("improves_raw") & F.col("confident_raw") & (F.col("unusable") == 0))
    )


def slice_table(df: DataFrame, trigger: Trigger, line: DataFrame, month: str = "month",
                tail_above: float = 3600, floor: float | None = None) -> DataFrame:
    """Where an overlaid change comes from: both RMSEs per (overlapping) slice."""
    y = F.col(trigger.target)
    slices = {"target_normal": y <= tail_above, "target_tail": y > tail_above,
              "flag_set": F.col(trigger.flag) == 1, "flag_clear": F.col(trigger.flag) == 0,
              "month_01": F.col(month) == 1, "month_07": F.col(month) == 7}
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]))
    return (
        _arms(df, trigger, line, floor).select("se_base_overlaid", "se_cand_overlaid", F.explode(tags).alias("slice"))
        .groupBy("slice").agg(F.count("*").alias("n"), F.sqrt(F.avg("se_base_overlaid")).alias("base_rmse"),
                              F.sqrt(F.avg("se_cand_overlaid")).alias("cand_rmse"))
    )


def require_pass(verdict: DataFrame) -> dict:
    """Read one persisted verdict and refuse to go on unless it passed."""
    rows = verdict.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one verdict row")
    if not rows[0]["passed"]:
        raise ValueError(f"gate {rows[0]['label']!r} failed; the final fit is not permitted")
    return rows[0].asDict()


def require_better(verdict: DataFrame, control: str = "base_raw", model: str = "cand_raw") -> tuple[float, float]:
    """Refuse a final fit unless the persisted model error is below the persisted control error."""
    row = verdict.select(control, model).limit(1).collect()
    if not row:
        raise ValueError("no persisted gate result")
    if not row[0][model] < row[0][control]:
        raise ValueError(f"model {row[0][model]} does not beat control {row[0][control]}")
    return row[0][control], row[0][model]
