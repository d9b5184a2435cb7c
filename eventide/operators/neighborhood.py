"""What happened around an event: counts, sums and overlaps on the event-time axis."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.clock import MINUTE_US
from eventide.functions.expr import ratio
from eventide.operators.prefix import BUCKET_US, state_at, totals_asked


@dataclass(frozen=True)
class Frame:
    """Covers (t + after_us, t + until_us] around an instant t."""

    name: str
    after_us: int
    until_us: int


def prior(name: str, minutes: int) -> Frame:
    """The last ``minutes`` up to and including t; an event exactly that old is out."""
    return Frame(name, -minutes * MINUTE_US, 0)


def prior_closed(name: str, minutes: int) -> Frame:
    """Like ``prior`` but an event exactly that old is in."""
    return Frame(name, -minutes * MINUTE_US - 1, 0)


def following(name: str, minutes: int) -> Frame:
    """The next ``minutes`` after t; events at t itself are out."""
    return Frame(name, 0, minutes * MINUTE_US)


def frame_sums(events: DataFrame, keys: Sequence[str], at: str, measures: Mapping[str, str],
               frames: Sequence[Frame], probe: str = "true", width_us: int = BUCKET_US) -> DataFrame:
    """``<measure>_<frame>`` for each distinct probed (keys, at); measures and probe are SQL text.

    A frame sum is the running total at the frame's end less the one before its start. Events are
    added up per instant, each probed instant asks for the totals at its frame edges, and the
    answers meet again under the instant: linear in the events, however dense they are.
    """
    values = [f"_{m}" for m in measures]
    edges = sorted({e for f in frames for e in (f.after_us, f.until_us)})
    points = (
        events.dropna(subset=[*keys, at])
        .selectExpr(*keys, f"{at} as _at", f"{probe} as _probe", *[f"cast({c} as bigint) as _{m}" for m, c in measures.items()])
        .groupBy(*keys, "_at").agg(*[F.sum(v).alias(v) for v in values], F.max("_probe").alias("_probe"))
    )
    totals = totals_asked(points, keys, values, edges, width_us)

    def frame_sum(m: str, f: Frame) -> Column:
        signed = f"case _edge when {f.until_us} then _{m} when {f.after_us} then -_{m} end"
        return F.expr(f"sum({signed}) as {m}_{f.name}")

    return totals.groupBy(*keys, F.col("_of").alias(at)).agg(*[frame_sum(m, f) for f in frames for m in measures])


TRAFFIC_FRAMES = (prior("prev_15", 15), prior("prev_30", 30), prior("prev_60", 60),
                  following("next_15", 15), following("next_30", 30))
LANE_FRAMES = (prior("prev_15", 15), prior("prev_30", 30))
PLAN_FRAMES = (prior("prev_30", 30), following("next_30", 30))


def traffic_counts(moves: DataFrame, scope: Sequence[str] = (), entity: str = "entity",
                   at: str = "move_us", width_us: int = BUCKET_US) -> DataFrame:
    """Departures and arrivals around each departure instant, over the combined stream."""
    return frame_sums(moves, [*scope, entity], at,
                      {"dep": "if(phase = 'DEP', 1, 0)", "arr": "if(phase = 'ARR', 1, 0)"},
                      TRAFFIC_FRAMES, "coalesce(phase = 'DEP', false)", width_us)


def lane_counts(departures: DataFrame, scope: Sequence[str] = (), entity: str = "entity",
                lane: str = "lane", at: str = "move_us", width_us: int = BUCKET_US) -> DataFrame:
    """Departures on the same lane shortly before each departure."""
    return frame_sums(departures, [*scope, entity, lane], at, {"lane": "1"}, LANE_FRAMES, width_us=width_us)


def plan_counts(departures: DataFrame, scope: Sequence[str] = (), entity: str = "entity",
                at: str = "sched_us", width_us: int = BUCKET_US) -> DataFrame:
    """Departures planned around each departure's own planned time."""
    return frame_sums(departures, [*scope, entity], at, {"plan_dep": "1"}, PLAN_FRAMES, width_us=width_us)


CONGESTION = tuple(
    [f"dep_{f.name}" for f in TRAFFIC_FRAMES] + [f"arr_{f.name}" for f in TRAFFIC_FRAMES]
    + [f"lane_{f.name}" for f in LANE_FRAMES] + [f"plan_dep_{f.name}" for f in PLAN_FRAMES]
    + ["lane_share_30"]
)


def congestion(moves: DataFrame, scope: Sequence[str] = (), width_us: int = BUCKET_US) -> DataFrame:
    """One row per departure: id and the fifteen neighbourhood columns.

    ``scope`` columns (such as a dataset label) isolate universes from each other. Only narrow
    rows are joined here; a caller attaches wide rows once, by id.
    """
    dep = moves.filter(F.col("phase") == "DEP").select(*scope, "id", "entity", "lane", "move_us", "sched_us")
    return (
        dep.join(traffic_counts(moves, scope, width_us=width_us), [*scope, "entity", "move_us"], "left")
        .join(lane_counts(dep, scope, width_us=width_us), [*scope, "entity", "lane", "move_us"], "left")
        .join(plan_counts(dep, scope, width_us=width_us), [*scope, "entity", "sched_us"], "left")
        .withColumn("lane_share_30", ratio("lane_prev_30", "dep_prev_30"))
        .select("id", *CONGESTION)
    )


def completed_state(moves: DataFrame, scope: Sequence[str] = (), minutes: int = 60,
                    width_us: int = BUCKET_US) -> DataFrame:
    """Mean and number of arrival durations completed in the last ``minutes`` before each departure.

    Both ends of the frame are inside. No completion gives null for both. A row is either an
    arrival (counted when it completes) or a departure (a question), so one projection of one
    scan serves as change stream and probe.
    """
    done = "phase = 'ARR' and block_us is not null and duration_s is not null"
    events = moves.filter(f"phase = 'DEP' or ({done})").selectExpr(
        *scope, "entity", "if(phase = 'DEP', move_us, block_us) as at_us",
        "if(phase = 'ARR', duration_s, 0) as seconds", "if(phase = 'ARR', 1, 0) as n", "phase = 'DEP' as asks")
    state = frame_sums(events, [*scope, "entity"], "at_us", {"seconds": "seconds", "n": "n"},
                       [prior_closed("recent", minutes)], "asks", width_us)
    dep = moves.filter("phase = 'DEP'").selectExpr(*scope, "id", "entity", "move_us as at_us")
    return dep.join(state, [*scope, "entity", "at_us"], "left").selectExpr(
        "id", "if(n_recent > 0, seconds_recent / n_recent, null) as done_mean_60",
        "if(n_recent > 0, n_recent, null) as done_n_60")


def overlapping_intervals(rows: DataFrame, scope: Sequence[str] = (), entity: str = "entity",
                          start: str = "offblock_us", end: str = "move_us",
                          name: str = "active_at_start", width_us: int = BUCKET_US) -> DataFrame:
    """How many other intervals [start, end) of the entity are open at each row's start.

    An interval opens at its start and closes at its end; the running balance at a start, less
    the row's own interval, is the answer. Empty, reversed or half-null intervals never count.
    """
    valid = f"coalesce({end} > {start}, false)"
    changes = rows.selectExpr(*scope, entity, f"""inline(array(
        struct({start} as at_us, cast({valid} as bigint) as balance, true as _probe),
        struct(if({valid}, {end}, null) as at_us, -cast({valid} as bigint) as balance, false as _probe)))""")
    state = state_at(changes, [*scope, entity], "at_us", ["balance"], "_probe", width_us)
    return (
        rows.selectExpr(*scope, "id", entity, f"{start} as at_us", f"cast({valid} as bigint) as _own")
        .join(state, [*scope, entity, "at_us"], "left").selectExpr("id", f"balance - _own as {name}")
    )
