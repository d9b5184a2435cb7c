"""Choosing segments and configurations on a selection period."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.bootstrap import REPLICATES, paired_bootstrap
from eventide.operators.metrics import largest_row_share, squared_error

# The capacity grid and the selection rules.
CONFIGS = {
    "incumbent": {"leaves": 127, "min_data": 200},
    "leaves_down": {"leaves": 63, "min_data": 200},
    "leaves_up": {"leaves": 255, "min_data": 200},
    "min_data_down": {"leaves": 127, "min_data": 50},
    "min_data_up": {"leaves": 127, "min_data": 500},
}
MEMBER_MIN_GAIN, MEMBER_MIN_WIN, MEMBER_MAX_SHARE = 1.0, 0.80, 50.0
CAPACITY_CONFIDENCE = 0.9875


def select_members(df: DataFrame, segment: str, base: str, cand: str, truth: str,
                   min_gain: float = MEMBER_MIN_GAIN, min_win: float = MEMBER_MIN_WIN,
                   max_share: float = MEMBER_MAX_SHARE, replicates: int = REPLICATES,
                   id_col: str = "id") -> DataFrame:
    """Per segment: is the candidate better by enough, often enough, and not by one row?"""
    arms = df.withColumn("_b", squared_error(base, truth)).withColumn("_c", squared_error(cand, truth))
    point = arms.groupBy(segment).agg(
        F.count("*").alias("n"), F.sqrt(F.avg("_b")).alias("base_rmse"), F.sqrt(F.avg("_c")).alias("cand_rmse"),
        largest_row_share(F.col("_b") - F.col("_c")).alias("largest_share"))
    boot = paired_bootstrap(arms, id_col, {"rate": ("_b", "_c")}, [segment], replicates, many_groups=True)
    gain = F.col("base_rmse") - F.col("cand_rmse")
    return (
        point.join(boot.select(segment, F.col("win_rate")), segment).withColumn("gain", gain)
        .withColumn("selected", (F.col("gain") >= min_gain) & (F.col("win_rate") >= min_win)
                    & F.coalesce(F.col("largest_share") <= max_share, F.lit(False)))
    )


def adopt_members(df: DataFrame, members: DataFrame, segment: str, base: str, cand: str,
                  name: str = "pred") -> DataFrame:
    """The candidate in selected segments, the base everywhere else."""
    chosen = members.filter("selected").select(segment, F.lit(True).alias("_in"))
    return df.join(chosen, segment, "left").withColumn(
        name, F.when(F.col("_in"), F.col(cand)).otherwise(F.col(base))).drop("_in")


def compare_configs(df: DataFrame, names: Sequence[str], truth: str, replicates: int = REPLICATES,
                    confidence: float = CAPACITY_CONFIDENCE, incumbent: str = "incumbent",
                    id_col: str = "id") -> DataFrame:
    """One row per configuration against the incumbent.

    ``df`` has a raw prediction ``<name>`` and an overlaid one ``<name>_overlaid`` per
    configuration. All pairs share one bootstrap pass.
    """
    se = {f"_{n}": squared_error(n, truth) for n in names}
    se |= {f"_{n}_o": squared_error(f"{n}_overlaid", truth) for n in names}
    arms = df.select(id_col, F.lit(1).alias("_all"), *[c.alias(k) for k, c in se.items()])
    point = arms.groupBy("_all").agg(
        *[F.sqrt(F.avg(f"_{n}")).alias(f"raw_{n}") for n in names],
        *[F.sqrt(F.avg(f"_{n}_o")).alias(f"ovl_{n}") for n in names],
        *[largest_row_share(F.col(f"_{incumbent}_o") - F.col(f"_{n}_o")).alias(f"share_{n}") for n in names])
    pairs = {n: (f"_{incumbent}_o", f"_{n}_o") for n in names if n != incumbent}
    boot = paired_bootstrap(arms, id_col, pairs, ["_all"], replicates)
    rows = F.array(*[
        F.struct(F.lit(n).alias("config"), F.col(f"raw_{n}").alias("raw_rmse"),
                 F.col(f"ovl_{n}").alias("overlaid_rmse"),
                 (F.col(f"win_{n}") if n != incumbent else F.lit(None).cast("double")).alias("win_rate"),
                 F.col(f"share_{n}").alias("largest_share"),
                 F.col(f"raw_{incumbent}").alias("_raw0"), F.col(f"ovl_{incumbent}").alias("_ovl0"))
        for n in names])
    eligible = ((F.col("raw_rmse") < F.col("_raw0")) & (F.col("overlaid_rmse") < F.col("_ovl0"))
                & (F.col("win_rate") >= confidence))
    return (
        point.join(boot, "_all").select(F.inline(rows))
        .withColumn("eligible", F.coalesce(eligible, F.lit(False))).drop("_raw0", "_ovl0")
    )


def choose_config(df: DataFrame, compared: DataFrame, truth: str,
                  configs: Mapping[str, Mapping[str, int]] = CONFIGS, replicates: int = REPLICATES,
                  confidence: float = CAPACITY_CONFIDENCE, id_col: str = "id") -> DataFrame:
    """The smallest eligible configuration that the best one does not beat with confidence.

    Empty when nothing is eligible. The eligible names are at most the length of the grid.
    """
    best = [r["config"] for r in compared.filter("eligible").orderBy("overlaid_rmse", "config").collect()]
    spark = df.sparkSession
    schema = "config string, leaves int, min_data int"
    if not best:
        return spark.createDataFrame([], schema)
    top, rest = best[0], best[1:]
    contenders = [top]
    if rest:
        arms = df.select(id_col, F.lit(1).alias("_all"),
                         *[squared_error(f"{n}_overlaid", truth).alias(f"_{n}") for n in best])
        win = paired_bootstrap(arms, id_col, {n: (f"_{n}", f"_{top}") for n in rest}, ["_all"], replicates).first()
        contenders += [n for n in rest if win[f"win_{n}"] < confidence]
    table = spark.createDataFrame([(n, configs[n]["leaves"], configs[n]["min_data"]) for n in contenders], schema)
    return table.orderBy("leaves", F.desc("min_data"), "config").limit(1)
