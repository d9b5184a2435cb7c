"""Event-time neighbourhoods, as-of attachment, overlaps and the feature table."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventide.catalog.adapter import DEPS, MOVES, departures, moves
from eventide.catalog.registry import query, r6, rounded
from eventide.functions.clock import seconds_between
from eventide.functions.quantiles import medians
from eventide.operators.asof import asof_attach, latest_per_instant
from eventide.operators.codes import attach_codes, code_dimension, code_sizes, codes_of
from eventide.operators.neighborhood import (completed_state, congestion, lane_counts, overlapping_intervals,
                                             plan_counts, traffic_counts)
from eventide.plans.features import (CATEGORICAL, DELTAS, attach_by_id, build_features, coverage, queue_checks,
                                     row_features)
from eventide.plans.settle import settle
from eventide.sources.observations import attach_weather

TRAFFIC = ("dep_prev_15", "dep_prev_30", "dep_prev_60", "dep_next_15", "dep_next_30",
           "arr_prev_15", "arr_prev_30", "arr_prev_60", "arr_next_15", "arr_next_30")


def _frame(minutes: int, ahead: bool = False) -> str:
    us = minutes * 60_000_000
    return (f"range between 1 following and {us} following" if ahead
            else f"range between {us - 1} preceding and current row")


def _traffic(part: str) -> str:
    cols = []
    for kind, phase in (("dep", "DEP"), ("arr", "ARR")):
        for label, minutes, ahead in (("prev_15", 15, False), ("prev_30", 30, False), ("prev_60", 60, False),
                                      ("next_15", 15, True), ("next_30", 30, True)):
            cols.append(f"count(*) filter (phase = '{phase}') over (partition by {part} order by move_us "
                        f"{_frame(minutes, ahead)}) as {kind}_{label}")
    return ", ".join(cols)


def congestion_sql(scope: str = "") -> str:
    """CTEs traffic, lanes, plans and congestion; ``scope`` adds leading partition keys."""
    s = f"{scope}, " if scope else ""
    return f"""
    traffic as (select id, phase, {_traffic(s + 'entity')} from moves),
    lanes as (select id,
        count(*) over (partition by {s}entity, lane order by move_us {_frame(15)}) as lane_prev_15,
        count(*) over (partition by {s}entity, lane order by move_us {_frame(30)}) as lane_prev_30
      from moves where phase = 'DEP'),
    plans as (select id,
        count(*) over (partition by {s}entity order by sched_us {_frame(30)}) as plan_dep_prev_30,
        count(*) over (partition by {s}entity order by sched_us {_frame(30, True)}) as plan_dep_next_30
      from moves where phase = 'DEP'),
    congestion as (
      select t.* exclude (phase), lane_prev_15, lane_prev_30, plan_dep_prev_30, plan_dep_next_30,
        round(cast(lane_prev_30 as double) / dep_prev_30, 6) as lane_share_30
      from traffic t join lanes using (id) join plans using (id) where phase = 'DEP')
    """


@query("win1_5_traffic_counts", f"with {MOVES}, traffic as (select id, phase, {_traffic('entity')} from moves) "
       "select * exclude (phase) from traffic where phase = 'DEP'")
def traffic(spark, sf):
    m = moves(spark, sf)
    dep = m.filter(F.col("phase") == "DEP").select("id", "entity", "move_us")
    return dep.join(traffic_counts(m), ["entity", "move_us"], "left").select("id", *TRAFFIC)


@query("win6_7_lane_counts", f"with {MOVES}, {congestion_sql()} select * from lanes")
def lanes(spark, sf):
    dep = moves(spark, sf).filter(F.col("phase") == "DEP")
    return dep.join(lane_counts(dep), ["entity", "lane", "move_us"], "left").select(
        "id", "lane_prev_15", "lane_prev_30")


@query("win8_9_planned_counts", f"with {MOVES}, {congestion_sql()} select * from plans")
def plans(spark, sf):
    dep = moves(spark, sf).filter(F.col("phase") == "DEP")
    return dep.join(plan_counts(dep), ["entity", "sched_us"], "left").select(
        "id", "plan_dep_prev_30", "plan_dep_next_30")


@query("fea1_congestion", f"with {MOVES}, {congestion_sql()} select * from congestion")
def congestion_block(spark, sf):
    return rounded(congestion(moves(spark, sf)), "lane_share_30")


@query("src6_isolated_congestion",
       f"with {MOVES.replace('moves as (', 'base as (', 1)}, moves as (select *, case when period = 12 then 'rank' "
       f"else 'train' end as dataset from base), {congestion_sql('dataset')} select * from congestion")
def isolated_congestion(spark, sf):
    m = moves(spark, sf).withColumn("dataset", F.when(F.col("period") == 12, "rank").otherwise("train"))
    return rounded(congestion(m, ["dataset"]), "lane_share_30")


DONE_SQL = """
done as (
  select d.id, count(a.id) as n, avg(a.duration_s) as mean
  from moves d left join moves a on a.phase = 'ARR' and a.entity = d.entity {scope}
    and a.block_us between d.move_us - 3600000000 and d.move_us
  where d.phase = 'DEP' group by d.id)
"""


@query("win10_completed_state", f"with {MOVES}, {DONE_SQL.format(scope='')} select id, round(mean, 6) as done_mean_60, "
       "case when n > 0 then n end as done_n_60 from done")
def completed(spark, sf):
    return rounded(completed_state(moves(spark, sf)), "done_mean_60")


@query("src5_period_isolated_state", f"with {MOVES}, {DONE_SQL.format(scope='and a.period = d.period')} "
       "select id, round(mean, 6) as done_mean_60, case when n > 0 then n end as done_n_60 from done")
def completed_per_period(spark, sf):
    return rounded(completed_state(moves(spark, sf), ["period"]), "done_mean_60")


QUEUE_SQL = """
queue as (
  select q.id, case when q.offblock_us is not null then count(o.id) end as active_at_start
  from moves q left join moves o on o.phase = 'DEP' and o.period = q.period and o.entity = q.entity
    and o.id <> q.id and o.offblock_us < o.move_us
    and o.offblock_us <= q.offblock_us and q.offblock_us < o.move_us
  where q.phase = 'DEP' group by q.id, q.offblock_us)
"""


@query("jon8_overlapping_intervals", f"with {MOVES}, {QUEUE_SQL} select * from queue")
def overlapping(spark, sf):
    return overlapping_intervals(moves(spark, sf).filter(F.col("phase") == "DEP"), ["period"])


ASOF_SQL = """
obs as (select entity, move_us as seen_us, max(id) as obs_id from moves where phase = 'ARR' group by all),
hits as (
  select d.id, d.entity, d.move_us, o.obs_id, o.seen_us
  from moves d asof left join obs o on d.entity = o.entity and d.move_us >= o.seen_us
  where d.phase = 'DEP'),
matched as (
  select id, entity, case when move_us - seen_us <= 10800000000 then obs_id end as obs_id,
    case when move_us - seen_us <= 10800000000 then (move_us - seen_us) // 1000000 end as age_s
  from hits)
"""


def _asof(spark, sf):
    m = moves(spark, sf)
    obs = m.filter(F.col("phase") == "ARR").select("entity", F.col("move_us").alias("seen_us"),
                                                   F.col("id").alias("obs_id"))
    dep = m.filter(F.col("phase") == "DEP").select("id", "entity", "move_us")
    return asof_attach(dep, obs, ["entity"], "move_us", "seen_us").select(
        "id", "entity", "obs_id", seconds_between("move_us", "seen_us").alias("age_s"))


@query("jon7_asof_observation", f"with {MOVES}, {ASOF_SQL} select * from matched")
def asof(spark, sf):
    return _asof(spark, sf)


@query("agg12_match_audit", f"""with {MOVES}, {ASOF_SQL}
select entity, count(*) as n, count(obs_id) as matched, cast(median(age_s) as double) as median_age,
  max(age_s) as max_age, round(100.0 * count(obs_id) / count(*), 6) as matched_pct
from matched group by entity""")
def asof_audit(spark, sf):
    a = _asof(spark, sf)
    flat = a.groupBy("entity").agg(
        F.count("*").alias("n"), F.count("obs_id").alias("matched"), F.max("age_s").alias("max_age"),
        F.round(100.0 * F.count("obs_id") / F.count("*"), 6).alias("matched_pct"))
    return flat.join(medians(a, ["entity"], "age_s", "median_age"), "entity", "left")


@query("agg13_latest_per_instant", f"""with {MOVES}
select entity, move_us, max(id) as id, arg_max(duration_s, id) as duration_s
from moves where phase = 'ARR' group by entity, move_us""")
def latest(spark, sf):
    arr = moves(spark, sf).filter(F.col("phase") == "ARR").select("entity", "move_us", "id", "duration_s")
    return latest_per_instant(arr, ["entity"], "move_us", prefer=["id"])


ROW_SQL = """
rowfeat as (
  select id, duration_s, move_us, entity, lane, stand, regexp_replace(stand, '[0-9].*$', '') as area,
    kind, operator, segment, weight_class, flight_type, rule, dest,
    """ + ", ".join(
    f"case when {a} is not null and {b} is not null then greatest({lo}, least({hi}, ({a} - {b}) // 1000000)) end as {n}"
    for n, (a, b, (lo, hi)) in DELTAS.items()) + """,
    case when offblock_us is null then 1 else 0 end as offblock_missing,
    cast(hour(make_timestamp(move_us)) as int) as hour,
    cast(hour(make_timestamp(move_us)) * 60 + minute(make_timestamp(move_us)) as int) as minute_of_day,
    cast(isodow(make_timestamp(move_us)) as int) as weekday, cast(month(make_timestamp(move_us)) as int) as month,
    cast(dayofyear(make_timestamp(move_us)) as int) as day_of_year,
    case when isodow(make_timestamp(move_us)) >= 6 then 1 else 0 end as is_weekend,
    cast(hour(make_timestamp(sched_us)) * 60 + minute(make_timestamp(sched_us)) as int) as sched_minute_of_day
  from moves where phase = 'DEP')
"""


@query("prj1_7_row_features", f"with {MOVES}, {ROW_SQL} select * from rowfeat")
def row_level(spark, sf):
    dep = moves(spark, sf).filter(F.col("phase") == "DEP")
    return row_features(dep).select(
        "id", "duration_s", "move_us", *CATEGORICAL, *DELTAS, "offblock_missing", "hour", "minute_of_day",
        "weekday", "month", "day_of_year", "is_weekend", "sched_minute_of_day")


@query("prj8_lane_share", f"with {MOVES}, {congestion_sql()} select id, lane_share_30 from congestion")
def lane_share(spark, sf):
    return congestion(moves(spark, sf)).select("id", r6("lane_share_30"))


FEATURES_SQL = f"{MOVES}, {congestion_sql()}, {ROW_SQL}"


@query("fea2_feature_table", f"with {FEATURES_SQL} select * from rowfeat join congestion using (id)")
def feature_table(spark, sf):
    return rounded(build_features(moves(spark, sf)), "lane_share_30")


@query("fea3_attach_completed_state", f"""with {FEATURES_SQL}, {DONE_SQL.format(scope='and a.period = d.period')}
select id, duration_s, move_us, dep_prev_60, implied_duration, round(mean, 6) as done_mean_60,
  case when n > 0 then n end as done_n_60
from rowfeat join congestion using (id) join done using (id)""")
def with_completed(spark, sf):
    m = moves(spark, sf)
    base = build_features(m).select("id", "duration_s", "move_us", "dep_prev_60", "implied_duration")
    return rounded(attach_by_id(base, completed_state(m, ["period"])), "done_mean_60")


@query("fea4_attach_active_queue", f"""with {FEATURES_SQL}, {QUEUE_SQL}
select id, duration_s, move_us, dep_prev_60, implied_duration, active_at_start
from rowfeat join congestion using (id) join queue using (id)""")
def with_queue(spark, sf):
    m = moves(spark, sf)
    base = build_features(m).select("id", "duration_s", "move_us", "dep_prev_60", "implied_duration")
    return attach_by_id(base, overlapping_intervals(m.filter(F.col("phase") == "DEP"), ["period"]))


@query("fea5_attach_observation", f"""with {MOVES}, {ASOF_SQL}, {ROW_SQL}
select r.id, r.duration_s, r.move_us, r.implied_duration, m.obs_id, m.age_s
from rowfeat r join matched m using (id)""")
def with_observation(spark, sf):
    m = moves(spark, sf)
    obs = m.filter(F.col("phase") == "ARR").select("entity", F.col("move_us").alias("seen_us"),
                                                   F.col("id").alias("obs_id"))
    dep = row_features(m.filter(F.col("phase") == "DEP"))
    return asof_attach(dep, obs, ["entity"], "move_us", "seen_us").select(
        "id", "duration_s", "move_us", "implied_duration", "obs_id",
        seconds_between("move_us", "seen_us").alias("age_s"))


@query("agg20_state_coverage", f"""with {MOVES}, {DONE_SQL.format(scope='and a.period = d.period')}
select count(*) as rows, round(100.0 * count(mean) / count(*), 6) as coverage_pct,
  round(100.0 * avg(case when n >= 5 then 1.0 else 0.0 end), 6) as enough_pct,
  round(avg(case when n > 0 then n end), 6) as mean_support, min(case when n > 0 then n end) as min_support
from done""")
def state_coverage(spark, sf):
    c = coverage(completed_state(moves(spark, sf), ["period"]), "done_mean_60", "done_n_60")
    return rounded(c, "coverage_pct", "enough_pct", "mean_support")


@query("fea4_queue_invariants", f"""with {MOVES}, {QUEUE_SQL}
select count(*) as rows, count(*) filter (active_at_start < 0) as negative,
  count(*) filter (active_at_start is null) as nulls,
  (select count(*) from moves where phase = 'DEP' and offblock_us is null) as expected_nulls, true as ok
from queue""")
def queue_invariants(spark, sf):
    dep = moves(spark, sf).filter(F.col("phase") == "DEP")
    return queue_checks(dep, overlapping_intervals(dep, ["period"]))


CODED = ("entity", "lane", "stand", "operator", "dest")
DIM_SQL = "dims as (" + " union all ".join(
    f"select '{c}' as \"column\", value, cast(row_number() over (order by value) - 1 as int) as code "
    f"from (select distinct {c} as value from deps where {c} is not null)" for c in CODED) + ")"


def _dims(spark, sf):
    d = departures(spark, sf)
    return code_dimension([d.filter("period <= 6"), d.filter("period > 6")], CODED)


@query("enc1_shared_codes", f"with {DEPS}, {DIM_SQL} select * from dims")
def shared_codes(spark, sf):
    return _dims(spark, sf)


@query("enc1_attach_codes", f"""with {DEPS}, {DIM_SQL}
select d.id, """ + ", ".join(f"x{i}.code as {c}" for i, c in enumerate(CODED)) + " from deps d " + " ".join(
    f"left join dims x{i} on x{i}.\"column\" = '{c}' and x{i}.value = d.{c}" for i, c in enumerate(CODED)))
def coded_rows(spark, sf):
    d = departures(spark, sf).select("id", *CODED)
    return attach_codes(d, settle(_dims(spark, sf), "codes"), CODED)


@query("enc2_recovered_codes", f"with {DEPS}, {DIM_SQL} select value, code from dims where \"column\" = 'entity'")
def recovered_codes(spark, sf):
    return codes_of(_dims(spark, sf), "entity")


@query("agg21_category_sizes", f"with {DEPS}, {DIM_SQL} select \"column\", count(*) as categories from dims group by 1")
def category_sizes(spark, sf):
    return code_sizes(_dims(spark, sf))


WEATHER_LIKE_SQL = """
weather as (
  select entity, move_us as seen_us, duration_s, k, stand from moves where phase = 'ARR'
  qualify row_number() over (partition by entity, move_us order by id desc) = 1),
wx as (
  select d.id, d.move_us, w.seen_us, w.duration_s as obs_s, w.k as obs_k, w.stand as obs_stand
  from moves d asof left join weather w on d.entity = w.entity and d.move_us >= w.seen_us
  where d.phase = 'DEP'),
near as (select id, move_us, case when move_us - seen_us <= 10800000000 then seen_us end as seen_us, obs_s, obs_k, obs_stand from wx)
"""


@query("wx1_observation_features", f"""with {MOVES}, {WEATHER_LIKE_SQL}
select id, round(((move_us - seen_us) // 1000000) / 60.0, 6) as wx_age_minutes,
  case when seen_us is null then 1 else 0 end as wx_missing,
  case when seen_us is not null then round((obs_k - 32.0) * (5.0 / 9.0), 6) end as wx_temp_c,
  case when seen_us is not null then cast((obs_k - 32.0) * (5.0 / 9.0) <= 3.0 as int) end as wx_below_3c,
  case when seen_us is not null then round(sin(obs_s * pi() / 180.0), 6) end as wx_wind_sin,
  case when seen_us is not null then round(obs_s * cast(1.609344 as double), 6) end as wx_visibility_km,
  case when seen_us is not null then cast(least(case when obs_k % 3 = 0 then obs_s end, case when obs_k % 5 = 0 then obs_k * 10 end) as double) end as wx_ceiling_ft,
  case when seen_us is not null then cast(regexp_matches(obs_stand, 'A|7') as int) end as wx_rain
from near""")
def observation_block(spark, sf):
    """The weather block with the arrivals of the log in the role of the station feed."""
    m = moves(spark, sf)
    k, s = F.col("k"), F.col("duration_s")
    empty = F.lit("")
    obs = latest_per_instant(
        m.filter(F.col("phase") == "ARR").select("entity", F.col("move_us").alias("valid_us"), "id", "k", "duration_s", "stand"),
        ["entity"], "valid_us", prefer=["id"]).select(
        F.col("entity").alias("station"), "valid_us", k.cast("double").alias("tmpf"), k.cast("double").alias("dwpf"),
        s.cast("double").alias("drct"), s.cast("double").alias("sknt"), s.cast("double").alias("vsby"),
        s.cast("double").alias("gust"), F.regexp_replace("stand", "A|7", "RA").alias("wxcodes"),
        F.when(k % 3 == 0, "BKN").otherwise(empty).alias("skyc1"), F.when(k % 5 == 0, "OVC").otherwise(empty).alias("skyc2"),
        empty.alias("skyc3"), empty.alias("skyc4"), s.cast("double").alias("skyl1"),
        (k * 10).cast("double").alias("skyl2"), F.lit(None).cast("double").alias("skyl3"), F.lit(None).cast("double").alias("skyl4"))
    out = attach_weather(m.filter(F.col("phase") == "DEP").select("id", "entity", "move_us"), obs)
    return out.select("id", r6("wx_age_minutes"), "wx_missing", r6("wx_temp_c"), "wx_below_3c", r6("wx_wind_sin"),
                      r6("wx_visibility_km"), "wx_ceiling_ft", "wx_rain")
