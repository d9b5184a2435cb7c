"""Combining predictions and assembling the final output."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.expr import clip, finite, half_even, or_fail
from eventide.operators.contracts import join_same_ids
from eventide.operators.overlay import Trigger, apply_overlay

BLEND_WEIGHT = 0.5


def blend(left: DataFrame, right: DataFrame, left_weight: float = BLEND_WEIGHT, id_col: str = "id",
          pred: str = "pred") -> DataFrame:
    """Fixed-weight mean of two prediction tables that must hold the same ids, each once, and finite values only."""
    if not 0.0 <= left_weight <= 1.0:
        raise ValueError("left_weight must be between 0 and 1")
    r = right.select(id_col, F.col(pred).alias("_r"))
    both = join_same_ids(left.select(id_col, pred), r, id_col, "prediction ids")
    return both.filter(or_fail(finite(pred) & finite("_r"), "a prediction to be blended is not finite")).select(
        id_col, (left_weight * F.col(pred) + (1.0 - left_weight) * F.col("_r")).alias(pred))


def blend_segments(df: DataFrame, segment: str, scope: Sequence, base: str, specialist: str,
                   weight: float = BLEND_WEIGHT, name: str = "pred") -> DataFrame:
    """Blend with the specialist inside the scope; outside, the base is passed on untouched."""
    mixed = (1.0 - weight) * F.col(base) + weight * F.col(specialist)
    inside = F.coalesce(F.col(segment).isin(*scope), F.lit(False)) & F.col(specialist).isNotNull()
    return df.withColumn(name, F.when(inside, mixed).otherwise(F.col(base)))


def substitute(base: DataFrame, subset: DataFrame, id_col: str = "id", pred: str = "pred") -> DataFrame:
    """Replace the predictions of the ids in ``subset``, change nothing else."""
    new = subset.select(id_col, F.col(pred).alias("_new"))
    return base.join(new, id_col, "left").select(
        *[c for c in base.columns if c != pred], F.coalesce(F.col("_new"), F.col(pred)).alias(pred))


def reproduction(rebuilt: DataFrame, preserved: DataFrame, id_col: str = "id", pred: str = "pred",
                 tolerance: float = 1e-9) -> DataFrame:
    """One row: rows, rows that differ, largest difference, ids without a partner, and ``ok``."""
    p = preserved.select(id_col, F.col(pred).alias("_p"), F.lit(1).alias("_in"))
    j = rebuilt.select(id_col, F.col(pred).alias("_q"), F.lit(1).alias("_out")).join(p, id_col, "full")
    delta = F.abs(F.col("_q") - F.col("_p"))
    return j.agg(
        F.count("*").alias("n"), F.count_if(~F.col("_q").eqNullSafe(F.col("_p"))).alias("changed"),
        F.coalesce(F.max(delta).cast("double"), F.lit(0.0)).alias("max_change"),
        F.count_if(F.col("_in").isNull() | F.col("_out").isNull()).alias("unmatched"),
        F.count_if(F.col("_q").isNull() != F.col("_p").isNull()).alias("null_mismatch"),
    ).withColumn("ok", (F.col("unmatched") == 0) & (F.col("null_mismatch") == 0) & (F.col("max_change") <= tolerance))


def enforce_reproduction(rebuilt: DataFrame, preserved: DataFrame, tolerance: float = 1e-9, **how) -> None:
    row = reproduction(rebuilt, preserved, tolerance=tolerance, **how).first()
    if not row["ok"]:
        raise ValueError(f"reproduction failed: {row.asDict()}")


def recombine(df: DataFrame, segment: str, scope: Sequence, old_base: str, new_base: str, specialist: str,
              preserved: str, weight: float = BLEND_WEIGHT, tolerance: float = 1e-9) -> DataFrame:
    """Put preserved specialists on a new base; the job fails at a row where they do not rebuild the old blend.

    The proof rides on each row, so the input is computed once.
    """
    both = blend_segments(df, segment, scope, old_base, specialist, weight, "_old")
    both = blend_segments(both, segment, scope, new_base, specialist, weight, "pred")
    rebuilt = F.col("_old").eqNullSafe(F.col(preserved)) | (F.abs(F.col("_old") - F.col(preserved)) <= tolerance)
    return both.filter(or_fail(rebuilt, "preserved blend not reproduced")).drop("_old")


def fill_template(template: DataFrame, predictions: DataFrame, fallback: DataFrame, id_col: str = "id",
                  value: str = "duration_s", pred: str = "pred", bounds: tuple[float, float] | None = None) -> DataFrame:
    """Template columns and rows, values rounded half-even to the template's type.

    Ids without a prediction take the one-row ``fallback``.
    """
    kind = dict(template.dtypes)[value]
    rounded = half_even(F.coalesce(F.col("_p"), F.col("_f")))
    if bounds:
        rounded = clip(rounded, *bounds)
    p = predictions.select(id_col, F.col(pred).alias("_p"))
    return (
        template.drop(value).join(p, id_col, "left").withColumn("_f", fallback.scalar())
        .withColumn(value, rounded.cast(kind)).select(*template.columns)
    )


def assemble(scored: DataFrame, template: DataFrame, trigger: Trigger, line: DataFrame, fallback: DataFrame,
             scope: Sequence, base: str = "base", specialist: str = "specialist", segment: str = "entity",
             floor: float = 60.0, id_col: str = "id", value: str = "duration_s") -> DataFrame:
    """Clip, blend, overlay last, clip again, align with the template."""
    clipped = scored.withColumn("_g", clip(base, floor)).withColumn("_s", clip(specialist, floor))
    mixed = blend_segments(clipped, segment, scope, "_g", "_s", name="_m")
    final = apply_overlay(mixed, trigger, ["_m"], line).withColumn("pred", clip("_m_overlaid", floor))
    return fill_template(template, final.select(id_col, "pred"), fallback, id_col, value)
