"""Null, NaN, rounding and clipping behaviour of row expressions; exact quantiles."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions.clock import calendar, micros, seconds_between
from eventide.functions.expr import (banded, clip, finite, half_even, lenient_double, mapped, prefix_group, ratio, strict_minute, winsorised)
from eventide.functions.quantiles import LINEAR, NEAREST, exact_quantiles


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, " + schema)
            .orderBy("i").select(expr).collect()]


def test_clip_keeps_null(spark):
    assert values(spark, clip("x", -2, 3), [None, -5, 1, 9], "x long") == [None, -2, 1, 3]
    assert values(spark, winsorised("x", 10), [None, 5, 50], "x long") == [None, 5.0, 10.0]


def test_seconds_truncate_toward_zero(spark):
    assert values(spark, seconds_between("a", "b"), [(0, 1_500_000), (1_500_000, 0), (None, 3)], "a long, b long") == [-1, 1, None]


def test_text_and_number_helpers(spark):
    assert values(spark, prefix_group("s"), ["A12B", "B", "7", None], "s string") == ["A", "B", "", None]
    assert values(spark, lenient_double("s"), ["1.5", "x", None], "s string") == [1.5, None, None]
    assert values(spark, ratio("a", "b"), [(1, 2), (1, 0), (None, 1)], "a long, b long") == [0.5, None, None]
    assert values(spark, half_even("x"), [0.5, 1.5, 2.5, -0.5], "x double") == [0.0, 2.0, 2.0, 0.0]
    assert values(spark, mapped("s", {"a": 1}, -1), ["a", "b", None], "s string") == [1, -1, -1]
    assert values(spark, banded("x", [(1, "low"), (5, "mid")], "high"), [1, 2, 9, None], "x long") == ["low", "mid", "high", "high"]
    assert values(spark, finite("x"), [1.0, float("nan"), float("inf"), None], "x double") == [True, False, False, False]


def test_strict_parse_fails_on_bad_text(spark):
    assert values(spark, micros(strict_minute("s")), ["2024-01-01 00:01"], "s string") == [1704067260000000]
    with pytest.raises(Exception, match="2024-01-01T00:01"):
        values(spark, strict_minute("s"), ["2024-01-01T00:01"], "s string")


def test_calendar(spark):
    c = calendar("us")
    row = spark.createDataFrame([(1704585600000000,)], "us long").select(*[v.alias(k) for k, v in c.items()]).first()  # Sunday 2024-01-07
    assert row.asDict() == {"hour": 0, "minute_of_day": 0, "weekday": 7, "month": 1, "day_of_year": 7, "day": 7}


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_exact_quantiles(spark, n):
    rnd = random.Random(n)
    data = {g: [rnd.choice([rnd.gauss(0, 100), float(rnd.randrange(5))]) for _ in range(n)] for g in "ab"}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    qs = (0.0, 0.05, 0.5, 0.9, 1.0)
    wanted = {f"l{i}": (q, LINEAR) for i, q in enumerate(qs)} | {f"n{i}": (q, NEAREST) for i, q in enumerate(qs)}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", wanted, fits=3).collect()}
    assert set(got) == {"a", "b"}
    for g, vs in data.items():
        s = sorted(vs)
        for i, q in enumerate(qs):
            assert got[g][f"l{i}"] == pytest.approx(np.percentile(s, 100 * q), abs=1e-9)
            assert got[g][f"n{i}"] == s[int((n - 1) * q + 0.5)]


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 9.0), ("a", 4.0)], "g string, v double")
    assert {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": (0.5, LINEAR)}).collect()} == {None: 2.0, "a": 4.0}


def test_quantiles_without_keys(spark):
    df = spark.range(1001).select(F.col("id").alias("v"))
    assert exact_quantiles(df, [], "v", {"m": (0.5, LINEAR), "p": (0.95, NEAREST)}).first().asDict() == {"m": 500.0, "p": 950}


def test_clip_leaves_null_and_nan_alone(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (5.0,), (-1.0,), (99.0,)], "x double")
    got = [r[0] for r in rows.select(clip("x", 0.0, 10.0)).collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [5.0, 0.0, 10.0]
