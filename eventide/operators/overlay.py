"""Rule overlays on top of a model, and affine calibration."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.expr import clip, finite, nan_to_null, or_fail
from eventide.functions.quantiles import LINEAR, exact_quantiles, with_quantiles
from eventide.operators.metrics import percent_true, squared_error
from eventide.plans.settle import settle

# Fixed values.
THRESHOLD = 14_400
SWEEP = (3600, 5400, 7200, 10800, 14400, 21600, 28800)
MIN_TRIGGER_ROWS = 20
MIN_HOLDOUT_ROWS = 24
MIN_OTHER_ROWS = 10
SHRINK = 0.95


@dataclass(frozen=True)
class Trigger:
    """Rows the rule replaces: entity in scope, indicator set, delta above the threshold."""

    scope: tuple[str, ...] | None
    threshold: float = THRESHOLD
    entity: str = "entity"
    flag: str = "offblock_missing"
    delta: str = "move_minus_sched"
    target: str = "duration_s"

    def x(self) -> Column:
        return nan_to_null(self.delta)

    def eligible(self) -> Column:
        """The condition without its threshold; an unknown delta never triggers."""
        ok = F.coalesce(F.col(self.flag) == 1, F.lit(False)) & self.x().isNotNull()
        if self.scope is not None:
            ok = ok & F.coalesce(F.col(self.entity).isin(*self.scope), F.lit(False))
        return ok

    def hit(self) -> Column:
        return self.eligible() & (self.x() > self.threshold)


def fit_line(df: DataFrame, x: str | Column, y: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Least squares y = intercept + slope * x per group, with its row count."""
    x = F.col(x) if isinstance(x, str) else x
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("intercept"),
                               F.regr_slope(y, x).alias("slope"))


def fit_overlay(df: DataFrame, trigger: Trigger, min_rows: int = MIN_TRIGGER_ROWS) -> DataFrame:
    """One row (n, intercept, slope); no coefficients below ``min_rows`` trigger rows."""
    line = fit_line(df.filter(trigger.hit()), trigger.x(), trigger.target)
    enough = F.col("n") >= min_rows
    return line.select("n", F.when(enough, F.col("intercept")).alias("intercept"),
                       F.when(enough, F.col("slope")).alias("slope"))


def apply_overlay(df: DataFrame, trigger: Trigger, preds: Sequence[str], line: DataFrame | None = None,
                  floor: float | None = None, required: bool = False,
                  suffix: str = "_overlaid") -> DataFrame:
    """Replace triggered predictions by the fitted line (or the delta itself without a line).

    Adds ``<pred><suffix>`` per prediction and the flag ``touched``. Without coefficients the
    predictions stay, or the job fails if they are ``required``. ``line`` has one row and is
    read as a scalar subquery.
    """
    hit = trigger.hit()
    if line is None:
        value = trigger.x()
    else:
        a = line.select("intercept").scalar()
        b = line.select("slope").scalar()
        if required:
            a = F.coalesce(a, F.raise_error(F.lit("too few trigger rows to fit the overlay")).cast("double"))
        df = df.withColumn("_a", a).withColumn("_b", b)
        value = F.col("_a") + F.col("_b") * trigger.x()
        hit = hit & F.col("_a").isNotNull()
    if floor is not None:
        value = clip(value, floor)
    out = df.withColumn("touched", hit)
    for p in preds:
        out = out.withColumn(f"{p}{suffix}", F.when(F.col("touched"), value).otherwise(F.col(p).cast("double")))
    return out.drop("_a", "_b")


def _thresholds(trigger: Trigger, thresholds: Sequence[int]) -> Column:
    return F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t < trigger.x()))


def sweep(pool: DataFrame, test: DataFrame, pred: str, scopes: Mapping[str, tuple[str, ...] | None],
          thresholds: Sequence[int] = SWEEP, base: Trigger | None = None,
          min_rows: int = MIN_TRIGGER_ROWS) -> DataFrame:
    """RMSE for each (scope, threshold, form), lines fitted on ``pool`` only.

    Only triggered rows are repeated per configuration; everything else enters through one
    total. A configuration whose line lacks rows has no calibrated entry.
    """
    t0 = base or Trigger(None)
    se = squared_error(pred, t0.target)

    def triggered(df: DataFrame, cols: Sequence[Column]) -> DataFrame:
        tagged = F.array_compact(F.array(*[
            F.when(_with(t0, scope).eligible(), F.lit(name)) for name, scope in scopes.items()]))
        return (
            df.filter(t0.x() > min(thresholds)).select(*cols, F.explode(tagged).alias("scope"), t0.delta)
            .select("*", _thresholds(t0, thresholds).alias("threshold"))
        )

    lines = fit_line(triggered(pool, [F.col(t0.target)]), t0.x(), t0.target, ["scope", "threshold"])
    rows = triggered(test, [F.col(t0.target), se.alias("_se")])
    configs = rows.join(F.broadcast(lines), ["scope", "threshold"], "left")  # one row per configuration
    y, x = F.col(t0.target), t0.x()
    fitted = F.when(F.col("n") >= min_rows, F.col("intercept") + F.col("slope") * x)
    forms = F.array(F.struct(F.lit("identity").alias("form"), squared_error(x, y).alias("_new")),
                    F.struct(F.lit("calibrated").alias("form"), squared_error(fitted, y).alias("_new")))
    per = (
        configs.select("scope", "threshold", "_se", F.inline(forms)).filter(F.col("_new").isNotNull())
        .groupBy("scope", "threshold", "form")
        .agg(F.count("*").alias("replaced"), F.sum("_se").alias("_old"), F.sum("_new").alias("_new"))
    )
    whole = test.agg(F.count("*").alias("n"), F.sum(se).alias("sse"))
    n, sse = whole.select(F.col("n").cast("double")).scalar(), whole.select("sse").scalar()
    return per.withColumn("_n", n).withColumn("_sse", sse).select(
        "scope", "threshold", "form", "replaced",
        F.sqrt((F.col("_sse") - F.col("_old") + F.col("_new")) / F.col("_n")).alias("rmse"),
        (F.sqrt((F.col("_sse") - F.col("_old") + F.col("_new")) / F.col("_n"))
         - F.sqrt(F.col("_sse") / F.col("_n"))).alias("change"))


def _with(t: Trigger, scope: tuple[str, ...] | None) -> Trigger:
    return Trigger(scope, t.threshold, t.entity, t.flag, t.delta, t.target)


def best_configuration(swept: DataFrame) -> DataFrame:
    """The configuration with the lowest RMSE; ties in key order."""
    return swept.orderBy("rmse", "scope", "threshold", "form").limit(1)


def leave_one_month_out(df: DataFrame, trigger: Trigger, month: str = "month",
                        thresholds: Sequence[int] = SWEEP, min_rows: int = MIN_HOLDOUT_ROWS,
                        min_other: int = MIN_OTHER_ROWS) -> DataFrame:
    """Score overlay forms on months their line was not fitted on.

    Moments per (threshold, month) give the line of all other months as total less month, so
    there is one aggregation instead of one fit per month. The fallback is the median target
    of the scope.
    """
    scoped = df.filter(F.col(trigger.entity).isin(*trigger.scope)) if trigger.scope else df
    fallback = exact_quantiles(scoped, [], trigger.target, {"m": (0.5, LINEAR)}).scalar()
    y = F.col(trigger.target).cast("double")
    rows = (
        df.filter(trigger.eligible() & y.isNotNull())
        .select(F.col(month).alias("_month"), trigger.x().alias("x"), y.alias("y"),
                _thresholds(trigger, thresholds).alias("threshold"))
    )
    x, yy = F.col("x"), F.col("y")
    per = rows.groupBy("threshold", "_month").agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(yy).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(x * yy).alias("sxy"))
    totals = per.groupBy("threshold").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    o = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    slope = F.try_divide(o["n"] * o["sxy"] - o["sx"] * o["sy"], o["n"] * o["sxx"] - o["sx"] * o["sx"])
    lines = (
        per.join(totals, "threshold").filter((F.col("t_n") >= min_rows) & (o["n"] >= min_other))
        .select("threshold", "_month", slope.alias("b"), F.try_divide(o["sy"] - slope * o["sx"], o["n"]).alias("a"))
    )
    # At most thresholds x months lines.
    scored = rows.join(F.broadcast(lines), ["threshold", "_month"]).withColumn("_f", fallback)
    f = F.col("_f")
    forms = F.array(
        F.struct(F.lit("identity").alias("form"), x.alias("p")),
        F.struct(F.lit("shrunk").alias("form"), (SHRINK * x + (1 - SHRINK) * f).alias("p")),
        F.struct(F.lit("calibrated").alias("form"), (F.col("a") + F.col("b") * x).alias("p")))
    new, old = squared_error("p", "y"), squared_error("_f", "y")
    return (
        scored.select("threshold", "y", "_f", F.inline(forms))
        .groupBy("threshold", "form")
        .agg(F.count("*").alias("rows"), F.sum(old - new).alias("sse_removed"),
             (100 * (1 - F.sum(new) / F.sum(old))).alias("pct_removed"), F.count_if(new > old).alias("rows_worse"))
    )


def stability(df: DataFrame, trigger: Trigger, by: str, values: Sequence | None = None, min_rows: int = 1) -> DataFrame:
    """Per month or entity: trigger rows and how far the bare delta is from the target.

    ``values`` is a declared list of months or entities that are all reported, those without a
    trigger with 0 rows. Others need ``min_rows`` trigger rows to be reported.
    """
    e = F.abs(trigger.x() - F.col(trigger.target).cast("double"))
    rows = df.filter(trigger.hit()).select(by, e.alias("_abs"))
    flat = rows.groupBy(by).agg(F.count("*").alias("triggered"), F.max("_abs").alias("worst_abs"),
                                percent_true(F.col("_abs") <= 60).alias("within_60s"))
    out = with_quantiles(flat.filter(F.col("triggered") >= min_rows), rows, [by], "_abs", {"median_abs": (0.5, LINEAR)})
    if values is None:
        return out
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"`{by}` {df.schema[by].dataType.simpleString()}")
    return F.broadcast(listed).join(out, by, "left").fillna(0, ["triggered"])


def exposure(df: DataFrame, trigger: Trigger, thresholds: Sequence[int] = SWEEP) -> DataFrame:
    """Rows each threshold would touch, in scope and anywhere."""
    everywhere = _with(trigger, None)
    rows = df.filter(everywhere.eligible()).select(
        trigger.eligible().alias("_in"), _thresholds(trigger, thresholds).alias("threshold"))
    return rows.groupBy("threshold").agg(F.count_if("_in").alias("in_scope"), F.count("*").alias("anywhere"))


def calibrate(df: DataFrame, calibration: DataFrame, pred: str, truth: str, entity: str = "entity",
              min_rows: int = 1000, floor: float = 0.0, entities: Sequence | None = None) -> DataFrame:
    """Per-entity affine calibration fitted on other rows: ``<pred>_calibrated``.

    The job fails at an entity with fewer than ``min_rows`` calibration rows or no finite line, at a
    prediction that is not finite, and at one that the identity line would not give back exactly.
    Each of the declared ``entities`` must have rows to be calibrated.
    """
    lines = settle(calibration_lines(calibration, pred, truth, entity), "lines").select(
        entity, F.when(F.col("n") >= min_rows, F.col("intercept")).alias("_a"), F.col("slope").alias("_b"))
    if entities is not None:
        found = {r[0] for r in df.filter(F.col(entity).isin(*entities)).select(entity).distinct().collect()}
        if absent := sorted(set(entities) - found):
            raise ValueError(f"no rows to calibrate for {absent}")
    p = F.col(pred).cast("double")
    sound = (
        or_fail(finite("_a") & finite("_b"), "insufficient calibration rows")
        & or_fail(finite(pred), "a prediction to be calibrated is not finite")
        & or_fail(F.lit(0.0) + F.lit(1.0) * p == p, "the identity line does not reproduce the predictions")
    )
    value = F.col("_a") + F.col("_b") * p
    return (
        df.join(lines, entity, "left").filter(sound).withColumn(f"{pred}_calibrated", clip(value, floor))
        .withColumn("clipped", (value < floor).cast("int")).drop("_a", "_b")
    )


def calibration_lines(calibration: DataFrame, pred: str, truth: str, entity: str = "entity") -> DataFrame:
    return fit_line(calibration, F.col(pred).cast("double"), truth, [entity])
