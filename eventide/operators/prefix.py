"""Running totals along an ordered axis without one task per key.

A sliding range frame re-adds its whole content for every row, and a window partitioned by a
low-cardinality key puts that key into one task. Here the axis is cut into buckets: totals run
inside ``(keys, bucket)``, and what came before enters as one carry row per bucket, itself a
running sum over the small table of bucket totals.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.clock import MINUTE_US

BUCKET_US = 10 * MINUTE_US


def suited_width(points: DataFrame, keys: Sequence[str], at: str, rows: int = 1_000_000) -> int:
    """Bucket width that keeps the densest (key, bucket) near ``rows`` distinct instants.

    One narrow aggregation; worth it before a job on a log of unknown density. Any width gives
    the same result.
    """
    per_minute = points.dropna(subset=[*keys, at]).groupBy(*keys, F.expr(f"{at} div {MINUTE_US}").alias("_m")).agg(
        F.approx_count_distinct(at).alias("_n"))
    densest = per_minute.agg(F.max("_n")).first()[0] or 1
    return max(1, MINUTE_US * rows // densest)


def running_totals(points: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                   bucket: str) -> DataFrame:
    """Replace ``values`` by their running totals in the given order, inside each key.

    ``bucket`` is a SQL expression that never falls as the first order column grows. Rows that
    tie in ``order`` should not both carry values.
    """
    by = ", ".join([*keys, "_bucket"])
    cells = points.selectExpr("*", f"{bucket} as _bucket")
    along = f"(partition by {', '.join(keys)} order by _bucket rows between unbounded preceding and 1 preceding)"
    carry = (
        cells.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
        .selectExpr(*keys, "_bucket", *[f"coalesce(sum({v}) over {along}, 0) as {v}" for v in values])
    )
    # A carry row has no position of its own: null sorts first in its bucket.
    inside = f"(partition by {by} order by {', '.join(order)} rows between unbounded preceding and current row)"
    kept = [c for c in points.columns if c not in values]
    return (
        cells.unionByName(carry, allowMissingColumns=True)
        .selectExpr(*kept, *[f"sum({v}) over {inside} as {v}" for v in values])
        .filter(F.col(order[0]).isNotNull())
    )


def totals_asked(points: DataFrame, keys: Sequence[str], values: Sequence[str], edges: Sequence[int],
                 width_us: int = BUCKET_US) -> DataFrame:
    """Running totals at ``_at + edge`` for every point that asks.

    ``points`` has one row per (keys, _at) with amounts and the flag ``_probe``. Amounts and
    questions leave it in one pass, so both uses below share one shuffle of the points. Gives
    (keys, _of, _edge, values) with ``_of`` the asking instant.
    """
    zeros = ", ".join(f"0L as {v}" for v in values)
    own = f"struct(_at, 0 as _asks, 0L as _edge, {', '.join(values)})"
    asks = ", ".join(f"struct(_at + {e}L as _at, 1 as _asks, {e}L as _edge, {zeros})" for e in edges)
    stream = points.selectExpr(*keys, f"inline(concat(array({own}), if(_probe, array({asks}), array())))")
    totals = running_totals(stream, keys, ["_at", "_asks", "_edge"], values, f"_at div {width_us}")
    return totals.filter("_asks = 1").selectExpr(*keys, "_at - _edge as _of", "_edge", *values)


def state_at(changes: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], probe: str,
             width_us: int = BUCKET_US) -> DataFrame:
    """Sum of all changes up to and including each probed instant.

    ``changes`` holds signed amounts at ``at`` (micros). Changes at one instant are added up
    before anything is ordered, so a dense log shrinks to its distinct instants first. The
    result has one row per probed (keys, at). Rows with a null key or time take no part.
    """
    points = (
        changes.dropna(subset=[*keys, at]).groupBy(*keys, F.col(at).alias("_at"))
        .agg(*[F.sum(v).alias(v) for v in values], F.max(probe).alias("_probe"))
    )
    return totals_asked(points, keys, values, [0], width_us).selectExpr(*keys, f"_of as {at}", *values)
