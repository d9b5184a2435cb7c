"""Movement tables under canonical column names.

Canonical columns: id, phase (DEP or ARR), origin, destination, entity, lane, stand, area,
move_us, sched_us, block_us, offblock_us, filed_us, initial_us, last_us, arrive_us (long micros),
duration_s, and the categories kind, operator, segment, weight_class, flight_type, rule, dest.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.clock import micros
from eventide.functions.expr import prefix_group
from eventide.sources.files import scan

# Canonical name -> column of the source files.
SOURCE_TIMES = {
    "move_us": "MVT_TIME_UTC_mvt",
    "sched_us": "SCHED_TIME_UTC_mvt",
    "block_us": "BLOCK_TIME_UTC_mvt",
    "offblock_us": "AOBT_3_flt",
    "filed_us": "EOBT_1_flt",
    "initial_us": "IOBT_flt",
    "last_us": "LOBT_flt",
    "arrive_us": "ARVT_1_flt",
}
SOURCE_VALUES = {
    "id": "MVT_ID_mvt",
    "phase": "PHASE_mvt",
    "origin": "ADEP_mvt",
    "destination": "ADES_mvt",
    "lane": "RUNWAY_mvt",
    "stand": "STAND_mvt",
    "kind": "AIRCRAFT_TYPE_mvt",
    "rule": "FLIGHT_RULE_mvt",
    "operator": "AIRCRAFT_OPERATOR_flt",
    "segment": "MARKET_SEGMENT_flt",
    "weight_class": "WK_TBL_CAT_flt",
    "flight_type": "FLIGHT_TYPE_flt",
    "duration_s": "TAXITIME_SEC_mvt",
}


def reporting_entity(phase: str = "phase", origin: str = "origin", destination: str = "destination") -> Column:
    """The origin of a departure, the destination of everything else."""
    return F.when(F.col(phase) == "DEP", F.col(origin)).otherwise(F.col(destination))


def canonical(df: DataFrame, values: Mapping[str, str] = SOURCE_VALUES, times: Mapping[str, str] = SOURCE_TIMES,
              keep: Sequence[str] = ()) -> DataFrame:
    """Rename, convert times to micros, and derive entity, area and dest. Reads only named columns."""
    out = df.select(*keep, *[F.col(c).alias(n) for n, c in values.items()],
                    *[micros(c).alias(n) for n, c in times.items()])
    return (
        out.withColumn("entity", reporting_entity()).withColumn("area", prefix_group("stand"))
        .withColumn("dest", F.col("destination"))
    )


def load_movements(spark: SparkSession, paths: str | Sequence[str], dataset: str | None = None) -> DataFrame:
    """Movement files as one canonical table with the file they came from as ``period``."""
    wanted = [*SOURCE_VALUES.values(), *SOURCE_TIMES.values()]
    out = canonical(scan(spark, paths, wanted, period="period"), keep=["period"])
    return out.withColumn("dataset", F.lit(dataset)) if dataset else out
