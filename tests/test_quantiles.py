"""Quantiles, medians and codes whose values crowd together: exact results, and no task over a stated size."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions.quantiles import LINEAR, NEAREST, exact_quantiles, narrowed
from eventide.operators.codes import code_dimension, in_ranges


def brute(values, q, method):
    v = sorted(values)
    p = (len(v) - 1) * q
    if method == NEAREST:
        return v[int(np.floor(p + 0.5))]
    lo = int(np.floor(p))
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (v[hi] - v[lo]) * (p - lo)


def test_a_million_doubles_in_one_unit(spark):
    df = spark.range(1_000_000).select((F.rand(5) / 1).alias("v"), (F.col("id") % 3 == 0).alias("g"))
    hist = df.groupBy(F.struct("g").alias("_g"), F.col("v").alias("_v")).agg(F.count("*").alias("_n"))
    targets = hist.groupBy("_g").agg((F.sum("_n") / 2).cast("long").alias("_rank"))
    live, _ = narrowed(hist, targets, fits=1_000)
    assert live.groupBy("_g", "_cell").count().agg(F.max("count")).first()[0] <= 1_000
    got = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {"m": (0.5, LINEAR)}, fits=1_000).collect()}
    values = df.toPandas()
    assert got == {g: pytest.approx(values[values.g == g].v.median(), abs=1e-15) for g in (True, False)}


@pytest.mark.parametrize("fits", [1, 5, 100_000])
def test_any_scale_nulls_and_odd_values(spark, fits):
    r = random.Random(6)
    groups = {"tiny": [r.random() * 1e-300 for _ in range(60)], "huge": [r.choice([-1, 1]) * r.random() * 1.7e308 for _ in range(60)],
              "far": [0.0, 1e300] + [r.random() for _ in range(50)], "same": [7.0] * 9, "one": [3.5], None: [float(k) for k in range(40)],
              "ends": [float("-inf"), float("inf"), float("nan"), 1.0, 2.0, 3.0, 4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"a": (0.5, LINEAR), "b": (0.9, NEAREST), "c": (0.05, LINEAR), "d": (0.0, NEAREST)}
    got = {x.g: x for x in exact_quantiles(df, ["g"], "v", wanted, total="n", fits=fits).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        if g == "ends":
            assert (got[g].a, got[g].d) == (3.0, float("-inf"))
            continue
        for name, (q, method) in wanted.items():
            assert got[g][name] == pytest.approx(brute(vs, q, method), rel=1e-12)


def test_weights_count_as_rows(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 10, 1), (1, 11, 2), (2, 5, 1)], "g int, v int, w long")
    got = {r.g: (r.m, r.n) for r in exact_quantiles(df, ["g"], "v", {"m": (0.5, LINEAR)}, weight="w", total="n", fits=1).collect()}
    assert got == {1: (6.0, 6), 2: (5.0, 1)}


def test_codes_of_values_that_begin_alike(spark):
    df = spark.range(40_000).select(F.concat(F.lit("https://the-same-prefix/"), F.col("id")).alias("u"), (F.col("id") % 5).cast("string").alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # at this size Spark would merge all ranges
    try:
        ranges = in_ranges(df.select(F.lit("u").alias("column"), F.col("u").alias("value")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranges.groupBy("_p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 25_000
    codes = code_dimension([df, df.limit(10)], ["u", "w"])
    got = {r.value: r.code for r in codes.filter("column = 'u'").collect()}
    assert [got[v] for v in sorted(got)] == list(range(40_000))
    assert {r.value: r.code for r in codes.filter("column = 'w'").collect()} == {str(k): k for k in range(5)}
