"""The feature table: row features, congestion, shared codes, and the optional blocks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.clock import calendar, minute_of_day, seconds_between
from eventide.functions.expr import clip, missing_flag, prefix_group, weekend_flag
from eventide.operators.codes import attach_codes, code_dimension
from eventide.operators.contracts import join_same_ids
from eventide.operators.neighborhood import CONGESTION, congestion
from eventide.operators.prefix import BUCKET_US
from eventide.plans.settle import settle

# Clip ranges in seconds and the feature blocks.
WIDE = (-7200, 172800)
NARROW = (-14400, 14400)
LENGTH = (0, 86400)
DELTAS = {
    "implied_duration": ("move_us", "offblock_us", WIDE),
    "move_minus_sched": ("move_us", "sched_us", WIDE),
    "move_minus_last": ("move_us", "last_us", WIDE),
    "move_minus_filed": ("move_us", "filed_us", WIDE),
    "move_minus_initial": ("move_us", "initial_us", WIDE),
    "offblock_minus_sched": ("offblock_us", "sched_us", NARROW),
    "offblock_minus_filed": ("offblock_us", "filed_us", NARROW),
    "offblock_minus_initial": ("offblock_us", "initial_us", NARROW),
    "offblock_minus_last": ("offblock_us", "last_us", NARROW),
    "planned_length": ("arrive_us", "filed_us", LENGTH),
}
CATEGORICAL = ("entity", "lane", "stand", "area", "kind", "operator", "segment", "weight_class",
               "flight_type", "rule", "dest")
CLOCK = ("hour", "minute_of_day", "weekday", "month", "day_of_year", "is_weekend")
NUMERIC = (*DELTAS, "offblock_missing", *CLOCK, *CONGESTION)
FEATURES = (*CATEGORICAL, *NUMERIC)
SCHEDULE = ("sched_minute_of_day",)
ARRIVAL_STATE = ("done_mean_60", "done_n_60")
QUEUE = ("active_at_start",)


def row_features(dep: DataFrame) -> DataFrame:
    """Everything that needs one row only; a projection the scan can be pruned for."""
    cal = calendar("move_us")
    out = dep.withColumns({n: clip(seconds_between(a, b), *bounds) for n, (a, b, bounds) in DELTAS.items()})
    return out.withColumns({
        "offblock_missing": missing_flag("offblock_us"),
        **{n: cal[n] for n in ("hour", "minute_of_day", "weekday", "month", "day_of_year", "day")},
        "is_weekend": weekend_flag(cal["weekday"]),
        "sched_minute_of_day": minute_of_day("sched_us"),
        "area": prefix_group("stand"),
    })


def build_features(moves: DataFrame, scope: Sequence[str] = (), keep: Sequence[str] = (),
                   width_us: int = BUCKET_US) -> DataFrame:
    """Departure rows with id, target, take-off and every feature.

    The wide rows are shuffled once, by id, to meet the congestion columns.
    """
    dep = row_features(moves.filter(F.col("phase") == "DEP"))
    wide = dep.join(congestion(moves, scope, width_us), "id", "left")
    return wide.select("id", "duration_s", "move_us", *keep, *FEATURES, *SCHEDULE)


def build_coded(train: DataFrame, rank: DataFrame, columns: Sequence[str] = CATEGORICAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both feature tables under one shared coding, and the coding itself."""
    dimension = settle(code_dimension([train, rank], columns), "codes")
    return attach_codes(train, dimension, columns), attach_codes(rank, dimension, columns), dimension


def attach_by_id(base: DataFrame, additions: DataFrame) -> DataFrame:
    """Add columns by id; both sides must hold the same ids and no new name may exist already."""
    clash = sorted(set(additions.columns) & set(base.columns) - {"id"})
    if clash:
        raise ValueError(f"table already contains: {', '.join(clash)}")
    return join_same_ids(base, additions, what="feature ids")


def coverage(df: DataFrame, value: str, support: str | None = None, enough: int = 5) -> DataFrame:
    """One row: rows, percent with a value, percent with enough support, mean support."""
    aggs = [F.count("*").alias("rows"), (100 * F.avg(F.col(value).isNotNull().cast("double"))).alias("coverage_pct")]
    if support:
        n = F.coalesce(F.col(support), F.lit(0))
        aggs += [(100 * F.avg((n >= enough).cast("double"))).alias("enough_pct"), F.avg(support).alias("mean_support"),
                 F.min(support).alias("min_support")]
    return df.agg(*aggs)


def queue_checks(dep: DataFrame, queue: DataFrame, entity: str = "entity", start: str = "offblock_us") -> DataFrame:
    """One row: negative counts, nulls, and the nulls there must be (no start or no entity)."""
    expected = dep.agg(F.count_if(F.col(start).isNull() | F.col(entity).isNull()).alias("n")).scalar()
    out = queue.agg(F.count("*").alias("rows"), F.count_if(F.col("active_at_start") < 0).alias("negative"),
                    F.count_if(F.col("active_at_start").isNull()).alias("nulls"))
    return out.withColumn("expected_nulls", expected).withColumn(
        "ok", (F.col("negative") == 0) & (F.col("nulls") == F.col("expected_nulls")))
