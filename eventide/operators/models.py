"""Boosted trees, per-segment specialists and sub-population models."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.expr import clip, finite
from eventide.operators.audit import usable_columns
from eventide.operators.boosting import HELD, LABEL, Boosted, binned_matrix, boost, fit_binning
from eventide.operators.ordered import apply_statistics, fit_statistics, ordered_statistics

SEED = 4711
# The limit of rounds, the rounds waited for a better one, and the largest category the second learner takes as it is.
MAX_ROUNDS, PATIENCE = 3000, 100
AS_CODES = 2


@dataclass(frozen=True)
class TreeParams:
    """Level-wise trees: ``leaves`` of a leaf-wise learner maps to the depth that holds them.

    With inner rows, ``rounds`` is only a limit and ``patience`` ends the fit; without, exactly ``rounds`` trees are fitted.
    """

    rounds: int = MAX_ROUNDS
    patience: int = PATIENCE
    depth: int = 7
    step: float = 0.06
    min_rows: int = 20
    bins: int = 64
    row_fraction: float = 0.8
    feature_fraction: str = "all"
    seed: int = SEED

    @staticmethod
    def from_capacity(leaves: int, min_data: int, **kw) -> "TreeParams":
        return TreeParams(depth=max(1, (leaves - 1).bit_length()), min_rows=min_data, **kw)


def feature_set(base: Sequence[str], add: Sequence[Sequence[str]] = (), drop: Sequence[str] = (),
                available: Sequence[str] | None = None) -> list[str]:
    """Feature names after block toggles; names the table lacks are an error."""
    names = [c for c in base if c not in set(drop)] + [c for block in add for c in block]
    if available is not None:
        absent = sorted(set(names) - set(available))
        if absent:
            raise ValueError(f"feature table is missing: {', '.join(absent)}")
    return names


def category_sizes(df: DataFrame, categorical: Sequence[str]) -> dict[str, int]:
    """Values per declared category: codes from 0 to the largest, and one for unknown."""
    if not categorical:
        return {}
    row = df.agg(*[F.coalesce(F.max(F.col(c).cast("int")), F.lit(-1)).alias(c) for c in categorical]).first()
    return {c: row[c] + 2 for c in categorical}


def model_rows(df: DataFrame, features: Sequence[str], sizes: Mapping[str, int], keep: Sequence[str], ordered: Sequence[str] = (),
               missing: float = float("nan")) -> DataFrame:
    """Doubles. Declared categories, and only these, are nominal or, where ``ordered``, stand for themselves by their statistic.

    Category 0 is unknown: null, or a code that the fit rows lack. Other nulls become ``missing``: NaN, which gets a bin of its own, so that
    splits can route missing values apart, or a sentinel for learners that take finite values only.
    """
    def column(c: str):
        if c in ordered:
            return F.col(f"os_{c}").alias(c)
        if c not in sizes:
            return F.coalesce(F.col(c).cast("double"), F.lit(missing)).alias(c)
        known = (F.col(c) >= 0) & (F.col(c) < sizes[c] - 1)
        nominal = {"ml_attr": {"type": "nominal", "name": c, "num_vals": sizes[c]}}
        return F.when(known, F.col(c).cast("double") + 1).otherwise(F.lit(0.0)).alias(c, metadata=nominal)

    return df.select(*keep, *map(column, features))


@dataclass
class FittedModel:
    features: list[str]
    categorical: list[str]
    pipeline: PipelineModel
    sizes: dict[str, int]
    floor: float = 0.0
    prior: float = 0.0                      # mean target, for categories that the fit rows lack
    ordered: list[str] = field(default_factory=list)
    statistics: DataFrame | None = None     # of the ordered categories, over all fit rows
    errors: list[float] = field(default_factory=list)
    stopped: bool = False

    def predict(self, df: DataFrame, id_col: str = "id", name: str = "pred") -> DataFrame:
        """(id, prediction), never below the floor."""
        if self.ordered:
            df = apply_statistics(df, self.statistics, self.ordered, self.prior)
        rows = model_rows(df, self.features, self.sizes, [id_col], self.ordered)
        scored = self.pipeline.transform(rows)
        return scored.select(id_col, clip(F.col("prediction"), self.floor).alias(name))

    def importance(self, top: int | None = None) -> DataFrame:
        """(feature, share) by split gain, largest first."""
        gains = self.pipeline.stages[-1].featureImportances.toArray()
        total = float(gains.sum()) or 1.0
        rows = [(f, float(gains[k]) / total if k < len(gains) else 0.0) for k, f in enumerate(self.features)]
        spark = SparkSession.getActiveSession()
        out = spark.createDataFrame(rows, "feature string, share double").orderBy(F.desc("share"), "feature")
        return out.limit(top) if top else out

    @property
    def trees(self) -> int:
        return self.pipeline.stages[-1].getNumTrees

    def rounds(self) -> DataFrame:
        """(round, inner_rmse, kept): one row per round tried; kept ones make up the model."""
        rows = [(k + 1, e, k < self.trees) for k, e in enumerate(self.errors)]
        return SparkSession.getActiveSession().createDataFrame(rows, "round int, inner_rmse double, kept boolean")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)
        spark = SparkSession.getActiveSession()
        rows = [(c, self.sizes[c], c in self.ordered) for c in self.categorical] + [("", 0, False)]
        spark.createDataFrame(rows, "name string, size int, ordered boolean").withColumn("prior", F.lit(self.prior)).coalesce(1).write.mode("overwrite").parquet(f"{path}-categories")
        if self.ordered:
            self.statistics.write.mode("overwrite").parquet(f"{path}-statistics")


def load_model(path: str, features: Sequence[str], categorical: Sequence[str], floor: float = 0.0) -> FittedModel:
    spark = SparkSession.getActiveSession()
    rows = spark.read.parquet(f"{path}-categories").collect()  # declared columns
    ordered = [r["name"] for r in rows if r["ordered"]]
    return FittedModel(list(features), list(categorical), PipelineModel.load(path), {r["name"]: r["size"] for r in rows if r["name"]}, floor, rows[0]["prior"],
                       ordered, spark.read.parquet(f"{path}-statistics") if ordered else None)


@dataclass
class Prepared:
    """What fits of several configurations share: the written matrix and how rows become vectors."""
    matrix: DataFrame
    binning: PipelineModel
    sizes: dict[str, int]
    prior: float
    ordered: list[str]
    statistics: DataFrame | None
    features: list[str]
    categorical: list[str]
    bins: int
    held: bool

    def fit(self, params: TreeParams, floor: float = 0.0) -> FittedModel:
        made: Boosted = boost(self.matrix, params.rounds, params.patience if self.held else None, params.step, params.depth, params.min_rows, self.bins + 2,
                              params.row_fraction, params.feature_fraction, params.seed)
        return FittedModel(self.features, self.categorical, PipelineModel([*self.binning.stages, made.model]), self.sizes, floor, self.prior, self.ordered,
                           self.statistics, made.errors, made.stopped)


def prepare_fit(fit: DataFrame, features: Sequence[str], categorical: Sequence[str], target: str = "duration_s", bins: int = 64,
                inner: DataFrame | None = None, learner: str = "boosted", id_col: str = "id", seed: int = SEED) -> Prepared:
    """Bin and write the rows once.

    A category wider than the bins (or than the fit rows) cannot be nominal and is ordered by its target statistic; the learner
    "ordered" does that with every category of over two values. Bins of other columns do not depend on it.
    """
    if learner not in ("boosted", "ordered"):
        raise ValueError(f"unknown learner {learner!r}")
    categorical = [c for c in categorical if c in features]
    known = fit.filter(F.col(target).isNotNull())
    n, prior = known.agg(F.count(F.lit(1)), F.avg(F.col(target).cast("double"))).first()
    if not n:
        raise ValueError("no rows to fit on")
    sizes = category_sizes(fit, categorical)
    widest = min(bins, n) if learner == "boosted" else AS_CODES + 1  # sizes count unknown as a value
    ordered, statistics = [c for c in categorical if sizes[c] > widest], None
    held = inner.filter(F.col(target).isNotNull()) if inner is not None else None
    if ordered:
        statistics = fit_statistics(known, ordered, target, prior)
        known = known.join(ordered_statistics(known, ordered, target, prior, id_col, seed), id_col)
        held = apply_statistics(held, statistics, ordered, prior) if held is not None else None

    def rows(df: DataFrame, is_held: bool) -> DataFrame:
        named = df.withColumns({LABEL: F.col(target).cast("double"), HELD: F.lit(is_held)})
        return model_rows(named, features, sizes, [LABEL, HELD], ordered)

    train = rows(known, False)
    nominal = [c for c in categorical if c not in ordered]
    binning = fit_binning(train, features, nominal, bins)
    both = train if held is None else train.unionByName(rows(held, True))
    return Prepared(binned_matrix(both, binning), binning, sizes, prior, ordered, statistics, list(features), categorical, bins, held is not None)


def fit_trees(fit: DataFrame, features: Sequence[str], categorical: Sequence[str], target: str = "duration_s",
              params: TreeParams = TreeParams(), inner: DataFrame | None = None, learner: str = "boosted",
              floor: float = 0.0, id_col: str = "id") -> FittedModel:
    """Fit one model on the cluster. ``inner`` rows end the fit and choose the number of trees; they are never trained on.

    ``learner`` is "boosted", or "ordered", the second learner, which sees categories by their ordered statistics.
    """
    return prepare_fit(fit, features, categorical, target, params.bins, inner, learner, id_col, params.seed).fit(params, floor)


def fit_specialists(fit: DataFrame, segment: str, scope: Sequence, features: Sequence[str],
                    categorical: Sequence[str], inner: DataFrame | None = None, **how) -> dict:
    """One distributed fit per named segment, side by side; the scope is a short declared list."""
    def one(s) -> FittedModel:
        local = fit.filter(F.col(segment) == F.lit(s))
        held = inner.filter(F.col(segment) == F.lit(s)) if inner is not None else None
        if not local.limit(1).count():
            raise ValueError(f"segment {s!r} has no fit rows")
        return fit_trees(local, features, categorical, inner=held, **how)

    with ThreadPoolExecutor(max(1, len(scope))) as pool:
        return dict(zip(scope, pool.map(one, scope)))


def predict_specialists(models: Mapping, df: DataFrame, segment: str, id_col: str = "id",
                        name: str = "specialist") -> DataFrame:
    """(id, prediction) of the rows that have a specialist."""
    parts = [m.predict(df.filter(F.col(segment) == F.lit(s)), id_col, name) for s, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_subpopulation(fit: DataFrame, flag: str, features: Sequence[str], categorical: Sequence[str],
                      inner: DataFrame | None = None, **how) -> FittedModel:
    """A model for rows with the indicator set, on the features that carry values there."""
    mine = fit.filter(F.col(flag) == 1)
    usable = usable_columns(mine, [c for c in features if c != flag])
    held = inner.filter(F.col(flag) == 1) if inner is not None else None
    return fit_trees(mine, usable, categorical, inner=held, **how)


def capacity_grid(fit: DataFrame, configs: Mapping[str, Mapping[str, int]], features: Sequence[str],
                  categorical: Sequence[str], inner: DataFrame | None = None, params: TreeParams = TreeParams()) -> dict[str, FittedModel]:
    """One fit per configuration, side by side on one written matrix; ``params`` gives what the grid does not."""
    ready = prepare_fit(fit, features, categorical, bins=params.bins, inner=inner, seed=params.seed)

    def one(c: Mapping[str, int]) -> FittedModel:
        sized = TreeParams.from_capacity(c["leaves"], c["min_data"])
        return ready.fit(replace(params, depth=sized.depth, min_rows=sized.min_rows))

    with ThreadPoolExecutor(len(configs)) as pool:
        return dict(zip(configs, pool.map(one, configs.values())))


def all_finite(df: DataFrame, pred: str = "pred") -> bool:
    return not df.filter(~finite(pred)).limit(1).count()
