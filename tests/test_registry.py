"""Every registered query runs on the smallest tables; all with SQL agree with it there."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventide.catalog.adapter import SCOPE, departures
from tools.compare import connect, rows_of

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SAMPLE = ("win1_5_traffic_counts", "jon7_asof_observation", "jon8_overlapping_intervals", "win10_completed_state", "enc5_cross_fit",
          "bas1_backoff_lookups", "agg5_nearest_quantiles", "spl1_split_roles", "sub2_output_checks", "aud3_leakage_probe")


def test_names_and_pairs():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 120
    own = {n for n in q if n != "pipeline" and not n.startswith("op")}
    assert {n for n in own if n not in o} == {"mod1_rounds", "mod6_feature_importance", "sel2_fitted_comparison", "sel2_fitted_choice"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(SF).execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_monthly_stability_takes_every_entity(spark):
    late = departures(spark, SF).filter("offblock_missing = 1 and move_minus_sched > 3600")
    assert late.filter(~F.col("entity").isin(*SCOPE)).count() > 0
    got = entry.queries()["ovl5_stability_by_month"](spark, SF).collect()
    assert sorted(r["month"] for r in got) == list(range(1, 13)) and sum(r["triggered"] for r in got) == late.count()


@pytest.mark.skipif(not os.path.isdir(SF_MORE), reason="tables not present")
def test_calibration_takes_the_predictions_of_every_entity(spark):
    october = departures(spark, SF_MORE).filter("month = 10")
    got = entry.queries()["cal1_affine_calibration"](spark, SF_MORE)
    assert got.columns == ["id", "base_calibrated", "clipped"]
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in october.select("id").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "dep_prev_30" in df.columns
