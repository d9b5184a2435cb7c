"""From feature rows to a verdict: split, predict, persist, overlay, compare."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from eventide.functions.quantiles import medians
from eventide.operators.backoff import LEVELS, MIN_SUPPORT, control_prediction, fit_backoff
from eventide.operators.blend import assemble, blend_segments
from eventide.operators.contracts import contracted, enforce_output, validate_output
from eventide.operators.encoding import Spec, fit_map, transform
from eventide.operators.gates import require_pass
from eventide.operators.overlay import Trigger, fit_overlay
from eventide.operators.splits import Calendar, overlay_fit_mask, split_roles
from eventide.plans.settle import settle


def split_frames(df: DataFrame, split: str, cal: Calendar) -> dict[str, DataFrame]:
    """fit, inner and test rows of a split, and ``pool``, the rows an overlay may be fitted on."""
    frames = {role: df.filter(mask) for role, mask in split_roles(split, cal).items()}
    return {**frames, "pool": df.filter(overlay_fit_mask(split, cal))}


def closed_form_predictions(fit: DataFrame, rows: DataFrame, segment: str, scope: Sequence,
                            spec: Spec = Spec("te_lane_hour", ("entity", "lane", "hour")),
                            levels=LEVELS, min_support: int = MIN_SUPPORT, target: str = "duration_s") -> DataFrame:
    """Two predictors that need no training loop: ``base`` (median backoff) and ``cand``.

    The candidate blends the base with a smoothed encoding inside ``scope`` and equals it
    elsewhere. Both lookups are written once: the medians are read for groups and for the global
    fallback, and rows meet the encoding in a join planned from its real size.
    """
    medians = settle(fit_backoff(fit, levels, target, min_support=min_support), "medians")
    encoding = fit_map(fit, spec, target)
    out = control_prediction(rows, medians, levels, "base")
    return blend_segments(transform(out, {spec: encoding}), segment, scope, "base", spec.name, name="cand")


def scored_rows(df: DataFrame, split: str, cal: Calendar, scope: Sequence, **how) -> DataFrame:
    """Persisted test predictions of a split: what follows reads them instead of predicting again.

    They are written only if every id is present once and both predictions are finite, so every comparison starts from sound rows.
    """
    parts = split_frames(df, split, cal)
    both = closed_form_predictions(parts["fit"], parts["test"], cal.entity, scope, **how)
    return settle(contracted(both, ["base", "cand"], what=f"predictions of {split}"), "scored")


def scored_split(df: DataFrame, split: str, cal: Calendar, trigger: Trigger, scope: Sequence, **how) -> tuple[DataFrame, DataFrame]:
    """Persisted test predictions and the persisted overlay line, for both arms of a comparison."""
    line = settle(fit_overlay(split_frames(df, split, cal)["pool"], trigger), "line")
    return scored_rows(df, split, cal, scope, **how), line


def global_median(df: DataFrame, target: str = "duration_s") -> DataFrame:
    """One row: the median target, the fallback of ids without a prediction."""
    return medians(df, [], target, "median")


def publish(scored: DataFrame, template: DataFrame, trigger: Trigger, line: DataFrame, fallback: DataFrame, scope: Sequence,
            verdict: DataFrame | None = None, base: str = "base", specialist: str = "specialist", id_col: str = "id",
            value: str = "duration_s", **how) -> DataFrame:
    """The persisted output, or an error: predictions must keep the contract, the output must match its template.

    Specialists in ``scope`` enter only with the persisted ``verdict`` of the gate that let them pass; an output without any needs none.
    """
    if scope and verdict is None:
        raise ValueError("specialists need the verdict of their gate")
    if scope:
        require_pass(verdict)
    sound = contracted(scored, [base, specialist], id_col)
    out = settle(assemble(sound, template, trigger, line, fallback, scope, base, specialist, id_col=id_col, value=value, **how), "output")
    enforce_output(validate_output(out, template, id_col, value))
    return out
