"""Boosting with patience on a matrix that is binned and written once.

MLlib ends a fit at the first round that is no better. Here a fit runs for a stage of rounds, the inner error after every round is
read off in one pass, and the best round is kept if ``patience`` rounds after it brought nothing better; else the stage is doubled.
A fit is seeded, so a longer stage repeats the trees of the shorter one and goes on: all stages together cost at most twice the last.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import QuantileDiscretizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.plans.settle import settle, shared_dir

LABEL, VECTOR, HELD = "_label", "_features", "_held_out"


@dataclass
class Boosted:
    model: GBTRegressionModel   # the trees up to the best round
    errors: list[float]         # inner root mean squared error after each round; empty without inner rows
    stopped: bool               # ended by patience, not by the limit of rounds


def fit_binning(rows: DataFrame, features: Sequence[str], nominal: Sequence[str], bins: int) -> PipelineModel:
    """Quantile bins of all continuous features, found in one pass; missing values (NaN) get a bin of their own. Then the vector."""
    binned = [c for c in features if c not in nominal]
    stages = []
    if binned:
        stages.append(QuantileDiscretizer(inputCols=binned, outputCols=[f"{c}_bin" for c in binned], numBuckets=bins, handleInvalid="keep", relativeError=1e-3))
        # bins are marked as categories; the sum is a plain number, so that trees split by order
        stages.append(SQLTransformer(statement=f"select *, {', '.join(f'`{c}_bin` + 0 as `{c}_rank`' for c in binned)} from __THIS__"))
    stages.append(VectorAssembler(inputCols=[c if c in nominal else f"{c}_rank" for c in features], outputCol=VECTOR))
    return Pipeline(stages=stages).fit(rows)


def binned_matrix(rows: DataFrame, binning: PipelineModel) -> DataFrame:
    """(label, held out, vector), written once. Every round of every configuration reads this and never the features again."""
    return settle(binning.transform(rows).select(LABEL, HELD, VECTOR), "matrix")


def boost(matrix: DataFrame, rounds: int, patience: int | None, step: float, depth: int, min_rows: int, max_bins: int, row_fraction: float,
          feature_fraction: str, seed: int) -> Boosted:
    """Up to ``rounds`` trees. With ``patience``, rows held out decide when to stop and how many trees to keep; without, all are kept."""
    sc = SparkContext.getOrCreate()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(matrix.sparkSession))
    learner = GBTRegressor(featuresCol=VECTOR, labelCol=LABEL, stepSize=step, maxDepth=depth, maxBins=max_bins, minInstancesPerNode=min_rows, subsamplingRate=row_fraction,
                           featureSubsetStrategy=feature_fraction, seed=seed, checkpointInterval=10)
    train, inner = matrix.filter(~F.col(HELD)), matrix.filter(HELD)
    if patience is None:
        return Boosted(learner.setMaxIter(rounds).fit(train), [], False)
    if inner.isEmpty():
        raise ValueError("no inner rows to stop on")
    tried = min(rounds, 2 * patience)
    while True:
        fitted = learner.setMaxIter(tried).fit(train)
        errors = [e ** 0.5 for e in fitted.evaluateEachIteration(inner, "squared")]
        best = min(range(tried), key=errors.__getitem__) + 1
        if best + patience <= tried:
            return Boosted(first_trees(fitted, best), errors[:best + patience], True)
        if tried == rounds:
            return Boosted(first_trees(fitted, best), errors, False)
        tried = min(rounds, 2 * tried)


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model as it was after ``n`` rounds."""
    gateway, jvm = SparkContext.getOrCreate()._gateway, SparkContext.getOrCreate()._jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    own = model._java_obj.trees()
    for k in range(n):
        trees[k], weights[k] = own[k], model.treeWeights[k]
    made = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, trees, weights))
    made._java_obj.setFeaturesCol(VECTOR)
    return made
