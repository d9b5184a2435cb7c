"""Table audits: completeness, volumes, target distribution, leakage and residuals."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.clock import seconds_between
from eventide.functions.expr import banded, mapped
from eventide.functions.quantiles import LINEAR, NEAREST, medians, with_quantiles
from eventide.operators.metrics import error_concentration, error_metrics, percent_true, squared_error

# Fixed values.
TARGET_QUANTILES = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
BANDS = ((1800, "1. <=1800"), (3600, "2. 1800-3600"), (7200, "3. 3600-7200"), (20000, "4. 7200-20k"))
LAST_BAND = "5. >20k"


def distinct_with_null(c: str) -> Column:
    """Aggregate: distinct values, null counting as one."""
    return F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, dtype, nulls, null_pct) from one aggregate over all columns."""
    types = dict(df.dtypes)
    columns = list(columns or df.columns)
    counts = df.select(columns).agg(F.count("*").alias("_n"),
                                    *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                              F.col(f"_{i}").alias("nulls")) for i, c in enumerate(columns)])
    return counts.select("_n", F.inline(rows)).select(
        "column", "dtype", "nulls", F.round(100.0 * F.col("nulls") / F.greatest("_n", F.lit(1)), 3).alias("null_pct"))


def null_comparison(new: DataFrame, old: DataFrame) -> DataFrame:
    """Null rates of ``new`` next to those of the columns ``old`` shares with it."""
    n = null_profile(new).select("column", "dtype", F.col("nulls").alias("new_nulls"),
                                 F.col("null_pct").alias("new_null_pct"))
    o = null_profile(old).select("column", F.col("null_pct").alias("old_null_pct"))
    return n.join(o, "column", "left")


def schema_difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """Columns missing from or added by ``new``; schemas only, no data is read."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    rows = [("missing", c, a[c]) for c in a if c not in b] + [("added", c, b[c]) for c in b if c not in a]
    return new.sparkSession.createDataFrame(rows, "change string, column string, dtype string")


def usable_columns(df: DataFrame, columns: Sequence[str], max_null_rate: float = 0.5) -> list[str]:
    """Columns whose null rate stays below the limit, measured in one aggregate."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] < max_null_rate]


def counts_by(df: DataFrame, key: str, phase: str = "phase", phases: Sequence[str] = ("DEP", "ARR"),
              names: Mapping[str, str] | None = None) -> DataFrame:
    """One row per key, one count column per phase, 0 where there is none."""
    out = df.groupBy(key).pivot(phase, list(phases)).count().na.fill(0, list(phases))
    return out if names is None else out.withColumn("name", mapped(key, names, "(unexpected)"))


def target_summary(df: DataFrame, target: str, by: Sequence[str] = (),
                   quantiles: Sequence[float] = TARGET_QUANTILES) -> DataFrame:
    """Count, nulls, spread, suspicious ranges and nearest-rank quantiles of the target."""
    keys = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(1))
    t = F.col(target)
    flat = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(t.isNull()).alias("target_nulls"), F.min(t).alias("min"),
        F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.max(t).alias("max"),
        F.count_if(t <= 0).alias("le_zero"), F.count_if(t < 60).alias("under_1min"),
        F.count_if(t > 3600).alias("over_60min"))
    wanted = {f"p{q * 100:g}".replace(".", "_"): (q, NEAREST) for q in quantiles}
    wanted["median"] = (0.5, LINEAR)
    return with_quantiles(flat, df, keys, target, wanted).drop("_all")


def target_by_entity(df: DataFrame, target: str, entity: str = "entity",
                     distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Per entity: rows, median, mean, std, nearest-rank p90 and distinct counts of other columns."""
    t = F.col(target)
    flat = df.groupBy(entity).agg(
        F.count("*").alias("rows"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"),
        *[distinct_with_null(c).alias(n) for n, c in (distinct or {}).items()])
    return with_quantiles(flat, df, [entity], target, {"median": (0.5, LINEAR), "p90": (0.9, NEAREST)})


def integrity(df: DataFrame, id_col: str, mismatches: Mapping[str, tuple[str, str]],
              nulls: Mapping[str, str]) -> DataFrame:
    """One row: surplus ids, ``a <> b`` counts (null on either side is no mismatch), null counts."""
    return df.agg(
        (F.count("*") - distinct_with_null(id_col)).alias("duplicate_ids"),
        *[F.count_if(F.col(a) != F.col(b)).alias(n) for n, (a, b) in mismatches.items()],
        *[F.count_if(F.col(c).isNull()).alias(n) for n, c in nulls.items()])


def cardinalities(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, distinct_values), null counting as one value."""
    if approximate:
        aggs = [(F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"_{i}")
                for i, c in enumerate(columns)]
        one = df.agg(*aggs)
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"_{i}").cast("long").alias("distinct_values"))
            for i, c in enumerate(columns)])))
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    # Two plain aggregations with map-side combine instead of one Expand per distinct column.
    return pairs.distinct().groupBy("column").agg(F.count("*").alias("distinct_values"))


def leakage_probe(df: DataFrame, move: str, truth: str, candidates: Sequence[str],
                  matched: Column | None = None) -> DataFrame:
    """How well ``move - candidate`` (micros) gives the target away, over all and matched rows.

    Candidates become rows, so all of them share one scan and one aggregation.
    """
    pop = F.array_compact(F.array(F.lit("all"), *([F.when(matched, F.lit("matched"))] if matched is not None else [])))
    rows = (
        df.filter(F.col(truth).isNotNull())
        .select(truth, F.explode(pop).alias("population"), F.col(move).alias("_move"), F.array(*[
            F.struct(F.lit(c).alias("candidate"), F.col(c).alias("_at")) for c in candidates]).alias("_c"))
        .select(truth, "population", "_move", F.inline("_c"))
        .withColumn("implied", seconds_between("_move", "_at"))
    )
    by = ["population", "candidate"]
    coverage = rows.groupBy(*by).agg(percent_true(F.col("_at").isNotNull()).alias("coverage_pct"))
    return coverage.join(error_metrics(rows, "implied", truth, by), by, "left")


def availability(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, populated_pct)."""
    one = df.agg(*[percent_true(F.col(c).isNotNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("populated_pct")) for i, c in enumerate(columns)])))


def target_band(target: str) -> Column:
    return banded(target, BANDS, LAST_BAND)


def residual_audit(df: DataFrame, pred: str, truth: str, flag: str, entity: str, delta: str,
                   tail_features: Sequence[str], month: str = "month") -> dict[str, DataFrame]:
    """Where the error of a population with a missing indicator comes from, in six tables."""
    y = F.col(truth)
    se = squared_error(pred, truth)
    missing = df.filter(F.col(flag) == 1)
    total = df.agg(F.sum(se)).scalar()

    def of_all(sums: DataFrame) -> DataFrame:
        return sums.withColumn("_t", total).select(
            *[c for c in sums.columns if c != "se"], F.sqrt(F.col("se") / F.col("n")).alias("rmse"),
            (100 * F.try_divide(F.col("se"), F.col("_t"))).alias("pct_error"))

    by_entity = missing.groupBy(entity).agg(F.count("*").alias("n"), F.sum(se).alias("se"))
    by_band = missing.groupBy(target_band(truth).alias("band")).agg(F.count("*").alias("n"), F.sum(se).alias("se"))
    ae = missing.withColumn("_ae", F.abs(F.col(delta) - y))
    rebuild = ae.groupBy(entity).agg(
        F.count("*").alias("n"), percent_true(F.col("_ae") <= 60).alias("within_60s"),
        percent_true(F.col("_ae") <= 300).alias("within_300s"))
    tail = missing.filter(y.isNotNull()).select(
        (y > 3600).alias("is_tail"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v"))
                           for c in tail_features])))
    return {
        "concentration": error_concentration(df, pred, truth, [flag]),
        "entities": with_quantiles(of_all(by_entity), missing, [entity], truth, {"median_target": (0.5, LINEAR)}),
        "bands": of_all(by_band),
        "rebuild": with_quantiles(rebuild, ae, [entity], "_ae", {"median_ae": (0.5, LINEAR)}),
        "tail": medians(tail, ["feature", "is_tail"], "_v", "median"),
        "exposure": missing.groupBy(entity, month).agg(F.count("*").alias("n")),
    }
