"""Feature table to predictions: codes, leak-safe encodings, one fit, persisted predictions."""
from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.backoff import LEVELS, control_prediction, fit_backoff
from eventide.operators.contracts import contracted
from eventide.operators.encoding import DEFAULT_SPECS, encode_split
from eventide.operators.gates import require_better
from eventide.operators.models import FittedModel, TreeParams, feature_set, fit_trees
from eventide.operators.splits import Calendar, split_roles
from eventide.plans.settle import settle

# High-cardinality columns enter through encodings, the others as category codes.
CODED = ("entity", "lane", "area", "kind", "segment", "weight_class", "flight_type", "rule")
ENCODED = tuple(c for s in DEFAULT_SPECS for c in s.outputs)


def training_frames(features: DataFrame, codes: DataFrame, split: str, cal: Calendar, block: str = "month") -> dict[str, DataFrame]:
    """fit, inner and test rows with encodings and codes, each written once, side by side.

    Every learner passes over its rows many times; reading a written table keeps the feature
    plan from running again for each pass or after the loss of an executor.
    """
    parts = {r: features.filter(m) for r, m in split_roles(split, cal).items()}
    fit, (inner, test) = encode_split(parts["fit"], [parts["inner"], parts["test"]], block)
    roles = {"fit": fit, "inner": inner, "test": test}
    with ThreadPoolExecutor(len(roles)) as pool:
        return dict(zip(roles, pool.map(lambda role: settle(_coded(roles[role], codes), role), roles)))


def _coded(df: DataFrame, codes: DataFrame) -> DataFrame:
    for c in CODED:
        values = codes.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        df = df.join(values, c, "left")
    return df


def model_features(numeric: Sequence[str], drop: Sequence[str] = (), add: Sequence[Sequence[str]] = (),
                   available: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(all feature names, the categorical ones)."""
    codes = [f"{c}_code" for c in CODED]
    return feature_set([*codes, *numeric, *ENCODED], add, drop, available), codes


def model_inputs(numeric: Sequence[str]) -> list[str]:
    """Columns of the feature table that codes, encodings, the control and the model read."""
    keys = [c for spec in DEFAULT_SPECS for c in spec.keys] + [c for level in LEVELS for c in level]
    return list(dict.fromkeys(["id", "duration_s", *CODED, *numeric, *keys]))


def run_split(frames: dict[str, DataFrame], features: Sequence[str], categorical: Sequence[str],
              params: TreeParams = TreeParams(), learner: str = "boosted", target: str = "duration_s") -> tuple[FittedModel, DataFrame]:
    """Fit on fit, stop on inner, predict test; the control is fitted on the same rows.

    Gives the model and the persisted test rows with ``pred`` and ``control``.
    """
    model = fit_trees(frames["fit"], features, categorical, target, params, frames["inner"], learner)
    test = control_prediction(frames["test"], settle(fit_backoff(frames["fit"], target=target), "medians"), name="control")
    both = test.join(model.predict(frames["test"]), "id")
    return model, settle(contracted(both, ["pred", "control"]), "predictions")


def final_fit(verdict: DataFrame, labelled: DataFrame, ranking: DataFrame, codes: DataFrame, gated: FittedModel,
              params: TreeParams = TreeParams(), learner: str = "boosted", target: str = "duration_s", block: str = "month") -> tuple[FittedModel, DataFrame]:
    """A model of all labelled rows and its persisted predictions of ``ranking``.

    Refused unless the persisted ``verdict`` says that the gated model is better than its control. No
    rows are held back any more, so the number of trees is the one that the gated model kept.
    """
    require_better(verdict)
    train, (rank,) = encode_split(labelled, [ranking], block)
    train, rank = settle(_coded(train, codes), "train"), settle(_coded(rank, codes), "ranking")
    model = fit_trees(train, gated.features, gated.categorical, target, replace(params, rounds=gated.trees), learner=learner)
    return model, settle(contracted(rank.join(model.predict(rank), "id"), ["pred"], what="final predictions"), "predictions")
