"""The driver's tables in the roles the operators need, in Spark and in SQL.

``events`` is read as a movement log. The table spans 30 days, so 60 hours stand for a month and
2 hours for a day of month; everything else is taken from the row as it is.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.clock import hour_of, isodow_of, seconds_between
from eventide.functions.expr import clip, missing_flag
from eventide.session import prepare

SUMMER = ("S1", "S2", "S3")
SCOPE = ("S4", "S5", "S6", "S7")
SPECIALISTS = ("S1", "S2", "S3")


# The scaled calendar counts hours from this hour since 1970 on: 60 hours are a period, two hours of one a day.
ORIGIN_HOUR = 473_352  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movement log; ``MOVES`` is the same projection in SQL."""
    raw = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type in ('click', 'purchase') as dep",
        "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k", "cast(floor(value * 20) as bigint) as duration_s",
        "unix_micros(cast(ts as timestamp)) div 60000000 * 60000000 as move_us", f"unix_micros(cast(ts as timestamp)) div 3600000000 - {ORIGIN_HOUR} as hours")
    timed = raw.selectExpr("*", "move_us - duration_s * 1000000 - (k - 50) * 60000000 as sched_us")
    return timed.selectExpr(
        "event_id as id", "if(dep, 'DEP', 'ARR') as phase", "'S' || user_id % 10 as entity", "'L' || event_id % 3 as lane",
        "if(k % 2 = 0, 'A', 'B') || k as stand", "if(k % 2 = 0, 'A', 'B') as area", "'K' || k % 7 as kind",
        "'U' || user_id div 10 as operator", "'M' || user_id % 4 as segment", "'W' || k % 3 as weight_class",
        "'T' || user_id % 3 as flight_type", "'R' || k % 2 as rule", "'D' || k div 5 as dest",
        "k", "duration_s", "move_us",
        "move_us + if(dep, -duration_s, duration_s) * 1000000 as block_us", "sched_us",
        "if(k < 88, move_us - duration_s * 1000000 + (k - 50) * 1000000, null) as offblock_us",
        "sched_us + (k % 11 - 5) * 60000000 as filed_us", "sched_us - (k % 5) * 60000000 as initial_us",
        "sched_us + (k % 7) * 60000000 as last_us",
        "sched_us + (k % 11 - 5) * 60000000 + (3600 + k * 60) * 1000000 as arrive_us",
        "cast(hours div 60 + 1 as int) as period", "cast(hours % 60 div 2 + 1 as int) as pday")


MOVES = f"""
moves as (
  select event_id as id, case when dep then 'DEP' else 'ARR' end as phase,
    'S' || cast(user_id % 10 as varchar) as entity, 'L' || cast(event_id % 3 as varchar) as lane,
    case when k % 2 = 0 then 'A' else 'B' end || cast(k as varchar) as stand,
    case when k % 2 = 0 then 'A' else 'B' end as area,
    'K' || cast(k % 7 as varchar) as kind, 'U' || cast(user_id // 10 as varchar) as operator,
    'M' || cast(user_id % 4 as varchar) as segment, 'W' || cast(k % 3 as varchar) as weight_class,
    'T' || cast(user_id % 3 as varchar) as flight_type, 'R' || cast(k % 2 as varchar) as rule,
    'D' || cast(k // 5 as varchar) as dest,
    k, duration_s, move_us,
    case when dep then move_us - duration_s * 1000000 else move_us + duration_s * 1000000 end as block_us,
    sched_us,
    case when k < 88 then move_us - duration_s * 1000000 + (k - 50) * 1000000 end as offblock_us,
    sched_us + (k % 11 - 5) * 60000000 as filed_us, sched_us - (k % 5) * 60000000 as initial_us,
    sched_us + (k % 7) * 60000000 as last_us,
    sched_us + (k % 11 - 5) * 60000000 + (3600 + k * 60) * 1000000 as arrive_us,
    cast(hours // 60 + 1 as int) as period, cast((hours % 60) // 2 + 1 as int) as pday
  from (select *, move_us - duration_s * 1000000 - (k - 50) * 60000000 as sched_us
        from (select event_id, user_id, event_type in ('click', 'purchase') as dep,
                cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
                cast(floor(value * 20) as bigint) as duration_s,
                (epoch_us(ts) // 60000000) * 60000000 as move_us,
                epoch_us(ts) // 3600000000 - {ORIGIN_HOUR} as hours
              from events)))
"""


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures with the scaled calendar in ``month`` and ``day`` and the real clock in ``hour``."""
    m = moves(spark, sf_dir).filter(F.col("phase") == "DEP")
    return m.select(
        "*", F.col("period").alias("month"), F.col("pday").alias("day"),
        hour_of("move_us").alias("hour"), isodow_of("move_us").alias("weekday"),
        missing_flag("offblock_us").alias("offblock_missing"),
        clip(seconds_between("move_us", "sched_us"), -7200, 172800).alias("move_minus_sched"))


DEPS = MOVES + """,
deps as (
  select *, period as month, pday as day,
    cast(hour(make_timestamp(move_us)) as int) as hour, cast(isodow(make_timestamp(move_us)) as int) as weekday,
    case when offblock_us is null then 1 else 0 end as offblock_missing,
    greatest(-7200, least(172800, (move_us - sched_us) // 1000000)) as move_minus_sched
  from moves where phase = 'DEP')
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a fact table with a natural calendar: segment, nation, priority and price."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("entity"), F.col("c_nationkey").alias("stand"),
        F.col("o_orderpriority").alias("lane"), F.col("o_orderstatus").alias("hour"),
        (F.weekday("o_orderdate") + 1).alias("weekday"), F.month("o_orderdate").alias("month"),
        F.dayofmonth("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("duration_s"))


LEDGER = """
ledger as (
  select o_orderkey as id, c_mktsegment as entity, c_nationkey as stand, o_orderpriority as lane,
    o_orderstatus as hour, cast(isodow(o_orderdate) as int) as weekday, cast(month(o_orderdate) as int) as month,
    cast(day(o_orderdate) as int) as day, cast(floor(o_totalprice / 100) as bigint) as duration_s
  from orders join customer on o_custkey = c_custkey)
"""
