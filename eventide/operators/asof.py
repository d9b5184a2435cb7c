"""Backward as-of join with tolerance."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.clock import HOUR_US
from eventide.operators.prefix import BUCKET_US

TOLERANCE_US = 3 * HOUR_US


def latest_per_instant(obs: DataFrame, by: Sequence[str], on: str, prefer: Sequence[str] = ()) -> DataFrame:
    """One row per (by, on): the greatest in the order of ``prefer``, then of every other column."""
    rest = [c for c in obs.columns if c not in {*by, on}]
    order = [*prefer, *[c for c in rest if c not in prefer]]
    return (
        obs.groupBy(*by, on).agg(F.max(F.struct(*order)).alias("_row"))
        .select(*by, on, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def asof_attach(queries: DataFrame, obs: DataFrame, by: Sequence[str], at: str, obs_at: str,
                tolerance_us: int = TOLERANCE_US, width_us: int = BUCKET_US,
                prefer: Sequence[str] = ()) -> DataFrame:
    """Attach the latest observation with ``at - tolerance <= obs_at <= at`` of the same ``by``.

    Time is cut into buckets. Each bucket sees its own observations plus one carry row, the
    newest observation of all earlier buckets, so no task holds a whole entity. Only distinct
    question instants are ordered; the wide question rows meet the answers in one equi-join on
    (by, at). Observations at the same instant are resolved by ``prefer``, then by their fields.
    """
    by = list(by)
    keys = ", ".join(by)
    payload = [c for c in obs.columns if c not in by]
    bucket = f"_t div {width_us} as _bucket"
    seen = (
        latest_per_instant(obs.dropna(subset=[*by, obs_at]), by, obs_at, prefer)
        .selectExpr(*by, f"{obs_at} as _t", f"struct({', '.join(payload)}) as _obs")
    )
    asked = queries.dropna(subset=[*by, at]).selectExpr(*by, f"{at} as _t").distinct()
    cells = (
        seen.selectExpr("*", bucket, "0 as _asks")
        .unionByName(asked.selectExpr("*", bucket, "1 as _asks"), allowMissingColumns=True)
    )
    along = f"(partition by {keys} order by _bucket rows between unbounded preceding and 1 preceding)"
    carry = (
        cells.groupBy(*by, "_bucket").agg(F.expr("max_by(_obs, _t) filter (where _asks = 0) as _obs"))
        .selectExpr(*by, "_bucket", f"last(_obs, true) over {along} as _obs", "0 as _asks")
    )
    inside = f"(partition by {keys}, _bucket order by _t, _asks rows between unbounded preceding and current row)"
    answers = (
        cells.unionByName(carry, allowMissingColumns=True)
        .selectExpr(*by, "_t", "_asks", f"last(_obs, true) over {inside} as _obs")
        .filter(f"_asks = 1 and _t - _obs.{obs_at} <= {tolerance_us}")
        .selectExpr(*by, f"_t as {at}", *[f"_obs.{c} as {c}" for c in payload])
    )
    return queries.join(answers, [*by, at], "left")
