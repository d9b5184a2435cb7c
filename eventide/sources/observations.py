"""Station observations from CSV, their checks, and the features they carry."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.clock import micros, seconds_between, whole
from eventide.functions.expr import lenient_double, mapped, missing_flag, null_tokens, or_fail, strict_minute
from eventide.functions.quantiles import LINEAR, with_quantiles
from eventide.operators.asof import asof_attach, latest_per_instant
from eventide.operators.contracts import require_columns

# Source fields, null tokens, cover ordinals and weather patterns.
FIELDS = (
    "station", "valid", "tmpf", "dwpf", "drct", "sknt", "vsby", "gust", "wxcodes",
    "skyc1", "skyc2", "skyc3", "skyc4", "skyl1", "skyl2", "skyl3", "skyl4",
)
NUMBERS = ("tmpf", "dwpf", "drct", "sknt", "vsby", "gust", "skyl1", "skyl2", "skyl3", "skyl4")
TEXTS = ("wxcodes", "skyc1", "skyc2", "skyc3", "skyc4")
NULL_TOKENS = ("null", "M", "")
COVER = {"CLR": 0, "SKC": 0, "NSC": 0, "NCD": 0, "FEW": 1, "SCT": 2, "BKN": 3, "OVC": 4, "VV": 4}
CEILING_COVER = ("BKN", "OVC", "VV")
PATTERNS = {"wx_rain": "RA|DZ", "wx_snow": "SN|SG", "wx_freezing_precip": "FZRA|FZDZ|PL|IC",
            "wx_fog_mist": "FG|BR", "wx_thunder": "TS"}
KM_PER_MILE = 1.609344
AGE_LIMIT = 180.0
WEATHER = (
    "wx_age_minutes", "wx_missing", "wx_temp_c", "wx_dewpoint_c", "wx_dewpoint_depression_c", "wx_below_3c",
    "wx_freezing", "wx_wind_knots", "wx_gust_knots", "wx_wind_sin", "wx_wind_cos", "wx_visibility_km",
    "wx_ceiling_ft", "wx_sky_cover", "wx_rain", "wx_snow", "wx_freezing_precip", "wx_fog_mist", "wx_thunder",
)


def read_observations(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV with ``#`` comments and a header line, all text, null tokens made null."""
    raw = spark.read.option("comment", "#").option("header", True).option("enforceSchema", False).schema(
        T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])).csv(paths)
    return raw.select(*[null_tokens(f, NULL_TOKENS).alias(f) for f in FIELDS])


def clean_observations(raw: DataFrame) -> DataFrame:
    """Typed observations, one per (station, valid): the greatest in field order when repeated."""
    require_columns(raw, FIELDS, "observations")
    typed = raw.select(
        F.upper("station").alias("station"), micros(strict_minute("valid")).alias("valid_us"),
        *[lenient_double(c).alias(c) for c in NUMBERS],
        *[F.upper(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in TEXTS])
    return latest_per_instant(typed, ["station"], "valid_us")


def feed_check(raw: DataFrame, stations: Sequence[str], start: str, end: str,
               sequence: str | None = None) -> DataFrame:
    """(check, violations) of a feed: known stations, half-open time range, none absent, in order.

    ``sequence`` names a column that holds the row order of the source, if there is one.
    """
    require_columns(raw, FIELDS, "feed")
    at = strict_minute("valid")
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    # A station list is a fixed, short declaration.
    flat = raw.agg(
        (F.count("*") == 0).cast("long").alias("empty"),
        F.count_if(~F.coalesce(F.col("station").isin(*stations), F.lit(False))).alias("unexpected_station"),
        F.count_if(~F.coalesce((at >= lo) & (at < hi), F.lit(False))).alias("out_of_range"),
        *[(F.count_if(F.col("station") == s) == 0).cast("long").alias(f"_{i}") for i, s in enumerate(stations)])
    names = ["empty", "unexpected_station", "out_of_range"]
    rows = [F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in names]
    rows += [F.struct(F.lit(f"absent_{s}").alias("check"), F.col(f"_{i}").alias("violations"))
             for i, s in enumerate(stations)]
    out = flat.select(F.inline(F.array(*rows)))
    return out.unionByName(_order_violations(raw, sequence, at)) if sequence else out


def _order_violations(raw: DataFrame, sequence: str, at: Column, width: int = 1_000_000) -> DataFrame:
    """Rows earlier than the readable row before them.

    A stretch of the sequence is summed up by its first time, its last time and its violations, and
    neighbouring stretches are folded into one, ``_FAN`` at a time. No window sees more than that.
    """
    rows = raw.select(F.col(sequence).cast("long").alias("_s"), at.alias("_first")).filter("_first is not null and _s is not null")
    rows = rows.select(whole("_s", width).alias("_b"), "_s", "_first", F.col("_first").alias("_last"), F.lit(0).cast("long").alias("_bad"))
    folded = _fold(rows, ["_s", "_first"])
    for _ in range(_LEVELS):
        folded = _fold(folded.select(whole("_b", _FAN).alias("_b"), F.col("_b").alias("_s"), "_first", "_last", "_bad"), ["_s"])
    return folded.agg(F.coalesce(F.sum("_bad"), F.lit(0)).alias("violations")).select(F.lit("not_sorted").alias("check"), "violations")


# Stretches folded at a time; so many levels bring any 64-bit sequence down to one stretch.
_FAN, _LEVELS = 10_000, 4


def _fold(stretches: DataFrame, order: Sequence[str]) -> DataFrame:
    """One (first, last, violations) per ``_b`` from the stretches in it."""
    before = F.lag("_last").over(Window.partitionBy("_b").orderBy(*order))
    seam = (F.col("_first") < before).alias("_seam")
    place = F.struct(*order)
    return stretches.select("*", seam).groupBy("_b").agg(
        F.min_by("_first", place).alias("_first"), F.max_by("_last", place).alias("_last"),
        (F.sum("_bad") + F.count_if("_seam")).alias("_bad"))


def observation_features() -> list[Column]:
    """The columns that depend on the observation alone; computed once per observation."""
    temp, dew = [(F.col(c) - 32.0) * (5.0 / 9.0) for c in ("tmpf", "dwpf")]
    direction = F.col("drct") * F.lit(math.pi) / 180.0
    ceiling = F.least(*[F.when(F.col(f"skyc{i}").isin(*CEILING_COVER), F.col(f"skyl{i}")) for i in range(1, 5)])
    cover = F.greatest(*[mapped(f"skyc{i}", COVER) for i in range(1, 5)])
    return [
        temp.alias("wx_temp_c"), dew.alias("wx_dewpoint_c"), (temp - dew).alias("wx_dewpoint_depression_c"),
        (temp <= 3.0).cast("int").alias("wx_below_3c"), (temp <= 0.0).cast("int").alias("wx_freezing"),
        F.col("sknt").alias("wx_wind_knots"), F.col("gust").alias("wx_gust_knots"),
        F.sin(direction).alias("wx_wind_sin"), F.cos(direction).alias("wx_wind_cos"),
        (F.col("vsby") * KM_PER_MILE).alias("wx_visibility_km"), ceiling.alias("wx_ceiling_ft"),
        cover.alias("wx_sky_cover"),
        *[F.col("wxcodes").rlike(p).cast("int").alias(n) for n, p in PATTERNS.items()],
    ]


def attach_weather(rows: DataFrame, observations: DataFrame, entity: str = "entity", at: str = "move_us") -> DataFrame:
    """Add the nineteen weather columns of the latest observation no older than three hours.

    The job fails at a row without an entity, or if an observation from the future or an older one was attached.
    """
    obs = observations.select(F.col("station").alias(entity), "valid_us", *observation_features())
    joined = asof_attach(rows, obs, [entity], at, "valid_us")
    age = seconds_between(at, "valid_us") / 60.0
    mapped_rows = or_fail(F.col(entity).isNotNull(), "a row has no entity to look up observations by")
    in_time = or_fail(age.isNull() | age.between(0, AGE_LIMIT), "a future or stale observation was attached")
    return joined.filter(mapped_rows & in_time).select(*rows.columns, age.alias("wx_age_minutes"), missing_flag("valid_us").alias("wx_missing"),
                         *WEATHER[2:])


def match_audit(attached: DataFrame, entity: str = "entity") -> DataFrame:
    """Per entity: rows, matched rows, median and largest age of the match."""
    flat = attached.groupBy(entity).agg(
        F.count("*").alias("rows"), F.count_if(F.col("wx_missing") == 0).alias("matched"),
        F.min("wx_age_minutes").alias("min_age"), F.max("wx_age_minutes").alias("max_age"))
    return with_quantiles(flat, attached, [entity], "wx_age_minutes", {"median_age": (0.5, LINEAR)})


def enforce_age(attached: DataFrame, limit_minutes: float = AGE_LIMIT) -> None:
    """Fail if any match lies in the future or is older than the tolerance."""
    bad = (F.col("wx_age_minutes") < 0) | (F.col("wx_age_minutes") > limit_minutes)
    if attached.filter(bad).limit(1).count():
        raise ValueError("a future or stale observation was attached")
