"""Error metrics of predictions, overall and by slice."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.expr import as_col, finite
from eventide.functions.quantiles import LINEAR, exact_quantiles, with_quantiles


def squared_error(pred: str | Column, truth: str | Column) -> Column:
    d = as_col(pred).cast("double") - as_col(truth).cast("double")
    return d * d


def rmse(pred: str | Column, truth: str | Column) -> Column:
    """Aggregate: root mean squared error."""
    return F.sqrt(F.avg(squared_error(pred, truth)))


def error_metrics(df: DataFrame, pred: str, truth: str, by: Sequence[str], within=(1, 30, 60)) -> DataFrame:
    """n, rmse, mae, median_abs and ``within_<s>s`` percentages over pairs where both are finite."""
    e = F.col(pred).cast("double") - F.col(truth).cast("double")
    errors = df.filter(finite(pred) & finite(truth)).select(*by, F.abs(e).alias("_abs"))
    flat = errors.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("_abs") * F.col("_abs"))).alias("rmse"),
        F.avg("_abs").alias("mae"), *[percent_true(F.col("_abs") <= s).alias(f"within_{s}s") for s in within])
    return with_quantiles(flat, errors, by, "_abs", {"median_abs": (0.5, LINEAR)})


def percent_true(condition: Column) -> Column:
    """Aggregate: share of true among non-null conditions, in percent."""
    return F.avg(condition.cast("double")) * 100


def sliced_rmse(df: DataFrame, pred: str, truth: str, month: str = "month", entity: str = "entity") -> DataFrame:
    """RMSE by month and by (entity, month) in one aggregation; ``slice`` tells them apart."""
    rows = df.select(month, entity, squared_error(pred, truth).alias("_se"))
    g = rows.groupingSets([[month], [entity, month]], month, entity).agg(
        F.grouping(entity).alias("_m"), F.count("*").alias("n"), F.sqrt(F.avg("_se")).alias("rmse"))
    return g.select(F.when(F.col("_m") == 1, "month").otherwise("entity_month").alias("slice"),
                    month, entity, "n", "rmse")


def worst_slices(df: DataFrame, pred: str, truth: str, month: str = "month", entity: str = "entity") -> DataFrame:
    """(entity, month) slices, largest error first; ties in key order."""
    return (
        sliced_rmse(df, pred, truth, month, entity).filter(F.col("slice") == "entity_month")
        .drop("slice").orderBy(F.desc("rmse"), entity, month)
    )


def error_concentration(df: DataFrame, pred: str, truth: str, by: Sequence[str]) -> DataFrame:
    """Rows, RMSE and share of all squared error held by each slice."""
    per = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(squared_error(pred, truth)).alias("se"))
    whole = per.agg(F.struct(F.sum("n").alias("n"), F.sum("se").alias("se"))).scalar()
    return per.withColumn("_whole", whole).selectExpr(
        *by, "n", "sqrt(se / n) as rmse", "se", "100D * n / _whole.n as pct_rows", "100 * try_divide(se, _whole.se) as pct_error")


def largest_row_share(advantage: str | Column) -> Column:
    """Aggregate: percent of the net advantage owed to one row; null when there is none."""
    a = as_col(advantage)
    return F.when(F.sum(a) > 0, 100 * F.max(a) / F.sum(a))


def tail_report(df: DataFrame, pred: str, truth: str, flag: str, tail_above: float = 3600) -> DataFrame:
    """One row: overall errors, the normal and tail ranges, and rows with and without the flag."""
    se, t = squared_error(pred, truth), F.col(truth)
    tail, normal = t > tail_above, t <= tail_above
    on, off = F.col(flag) == 1, F.col(flag) == 0

    def part(cond: Column) -> Column:
        return F.sqrt(F.avg(F.when(cond, se)))

    head = df.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(se)).alias("rmse"),
        F.avg(F.abs(F.col(pred).cast("double") - t)).alias("mae"),
        F.count_if(normal).alias("n_normal"), part(normal).alias("rmse_normal"),
        F.count_if(tail).alias("n_tail"), part(tail).alias("rmse_tail"),
        (100 * F.try_divide(F.sum(F.when(tail, se)), F.sum(se))).alias("pct_error_tail"),
        F.count_if(on).alias("n_flagged"), part(on).alias("rmse_flagged"), part(off).alias("rmse_unflagged"))
    e = df.select(F.abs(F.col(pred).cast("double") - t).alias("_abs"))
    median = exact_quantiles(e, [], "_abs", {"m": (0.5, LINEAR)}).scalar()
    return head.withColumn("median_abs", median)
