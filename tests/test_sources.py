"""File readers and writers, the canonical movement schema, observation feeds, feature blocks."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.operators.audit import (cardinalities, counts_by, integrity, leakage_probe, null_profile, schema_difference, target_summary, usable_columns)
from eventide.plans.features import FEATURES, attach_by_id, build_coded, build_features, coverage, queue_checks
from eventide.plans.settle import settle, shared_dir
from eventide.sources.files import checksums, content_manifest, inventory, file_schemas, portable_rewrite, scan, schema_groups, write_checked, write_parquet
from eventide.sources.movements import load_movements
from eventide.sources.observations import FIELDS, attach_weather, clean_observations, enforce_age, feed_check, match_audit, read_observations

SOURCE = ("MVT_ID_mvt long, FLIGHT_ID_mvt long, FLIGHT_mvt string, FLIGHT_RULE_mvt string, ADEP_mvt string, ADES_mvt string, PHASE_mvt string, "
          "MVT_TIME_UTC_mvt timestamp_ntz, BLOCK_TIME_UTC_mvt timestamp_ntz, SCHED_TIME_UTC_mvt timestamp_ntz, AIRCRAFT_TYPE_mvt string, "
          "RUNWAY_mvt string, STAND_mvt string, TAXITIME_SEC_mvt int, LOBT_flt timestamp_ntz, IOBT_flt timestamp_ntz, EOBT_1_flt timestamp_ntz, "
          "AOBT_3_flt timestamp_ntz, ARVT_1_flt timestamp_ntz, MARKET_SEGMENT_flt string, FLIGHT_TYPE_flt string, WK_TBL_CAT_flt string, "
          "AIRCRAFT_OPERATOR_flt string")
T = dt.datetime(2025, 3, 1, 12, 0, 0)


def movement(i, phase="DEP", move=0, sched=-20, offblock=-15, taxi=900, origin="AAA", dest="BBB", stand="P12", seg="S"):
    at = lambda m: None if m is None else T + dt.timedelta(minutes=m)
    return (i, i, "F", "I", origin, dest, phase, at(move), at(move + 15 if phase == "ARR" else offblock), at(sched), "T", "R1", stand, taxi,
            at(sched), at(sched), at(sched - 5), at(offblock), at(90), seg, "X", "M", "OP")


def write_months(spark, path):
    spark.createDataFrame([movement(1), movement(2, move=10, offblock=None), movement(3, "ARR", origin="BBB", dest="AAA")], SOURCE) \
        .coalesce(1).write.parquet(f"{path}/training_a.parquet")
    spark.createDataFrame([movement(4, move=5, stand=None, seg=None), movement(5, "ARR", origin="AAA", dest="BBB")], SOURCE) \
        .coalesce(1).write.parquet(f"{path}/training_b.parquet")
    return [f"{path}/training_a.parquet", f"{path}/training_b.parquet"]


def test_movement_files_to_features(spark, tmp_path):
    m = load_movements(spark, write_months(spark, tmp_path), "train")
    rows = {r["id"]: r for r in m.collect()}
    assert {i: r["entity"] for i, r in rows.items()} == {1: "AAA", 2: "AAA", 3: "AAA", 4: "AAA", 5: "BBB"}
    assert rows[1]["area"] == "P" and rows[4]["area"] is None and rows[1]["dataset"] == "train"
    f = {r["id"]: r for r in build_features(m, ["dataset"]).collect()}
    assert set(f) == {1, 2, 4}
    one = f[1]
    assert (one["implied_duration"], one["move_minus_sched"], one["offblock_minus_filed"], one["planned_length"]) == (900, 1200, 600, 6900)
    assert (one["hour"], one["minute_of_day"], one["weekday"], one["month"], one["is_weekend"], one["sched_minute_of_day"]) == (12, 720, 6, 3, 1, 700)
    assert (one["dep_prev_60"], one["dep_next_15"], one["arr_prev_15"]) == (1, 2, 1)
    assert f[2]["implied_duration"] is None and f[2]["offblock_missing"] == 1 and f[2]["dep_prev_60"] == 3
    assert len(FEATURES) == 43


def test_scan_prunes_and_pushes(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    m = load_movements(spark, write_months(spark, tmp_path)).filter("phase = 'DEP'").select("id", "move_us")
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(PHASE_mvt), EqualTo(PHASE_mvt,DEP)]" in plan
    assert "ReadSchema: struct<MVT_ID_mvt:bigint,PHASE_mvt:string,MVT_TIME_UTC_mvt:timestamp_ntz" in plan


def test_shared_codes_over_both_tables(spark, tmp_path):
    m = build_features(load_movements(spark, write_months(spark, tmp_path)))
    train, rank, dim = build_coded(m.filter("id < 3"), m.filter("id >= 3"))
    assert {r["id"]: (r["stand"], r["entity"]) for r in train.unionByName(rank).collect()} == {1: (0, 0), 2: (0, 0), 4: (None, 0)}
    assert train.columns == m.columns


def test_a_folder_of_parts_is_one_table(spark, tmp_path):
    root = tmp_path / "odd %20 names"
    spark.range(10).repartition(3).write.parquet(str(root / "a.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(root / "deep" / "b.parquet"))
    (part,) = (root / "deep" / "b.parquet").glob("*.parquet")
    (root / "c + d.parquet").write_bytes(part.read_bytes())
    want = {("a.parquet", 10), ("b.parquet", 4), ("c + d.parquet", 4)}
    found = inventory(spark, str(root)).collect()
    assert len(found) == 3 and {(r["file"], r["rows"]) for r in found} == want
    found = file_schemas(spark, str(root)).collect()
    assert len(found) == 3 and {(r["file"], r["rows"]) for r in found} == want
    assert [r["tables"] for r in schema_groups(spark, str(root)).collect()] == [3]
    spark.range(2).selectExpr("id as other").coalesce(1).write.mode("append").parquet(str(root / "a.parquet"))
    assert sorted((r["file"], r["rows"]) for r in file_schemas(spark, str(root / "a.parquet")).collect()) == [("a.parquet", 2), ("a.parquet", 10)]


def test_file_level_operators(spark, tmp_path):
    paths = write_months(spark, tmp_path)
    inv = inventory(spark, str(tmp_path)).collect()
    assert sorted(r["rows"] for r in inv) == [2, 3] and all(r["bytes"] > 0 for r in inv)
    assert schema_groups(spark, paths).first()["tables"] == 2
    odd = tmp_path / "odd names" / "nothing%20here"
    spark.range(0).selectExpr("id as n", "timestamp_ntz'2025-01-01' as t").coalesce(1).write.parquet(str(odd))
    found = {(r["rows"], r["schema"]) for r in file_schemas(spark, [str(odd), *paths]).collect()}
    assert {r for r, _ in found} == {0, 2, 3} and (0, "struct<n:bigint,t:timestamp_ntz>") in found and len({s for _, s in found}) == 2
    back = portable_rewrite(spark, paths, str(tmp_path / "out"))
    assert back.count() == 5 and back.select("period").distinct().count() == 2
    a = content_manifest(spark, paths[0], ["MVT_ID_mvt", "STAND_mvt"]).first()
    spark.read.parquet(paths[0]).orderBy(F.desc("MVT_ID_mvt")).coalesce(1).write.parquet(str(tmp_path / "again"))
    b = content_manifest(spark, str(tmp_path / "again"), ["MVT_ID_mvt", "STAND_mvt"]).first()
    assert (a["rows"], a["checksum"]) == (b["rows"], b["checksum"])
    (tmp_path / "note.txt").write_bytes(b"abc")
    assert checksums(spark, str(tmp_path / "note.txt")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    df = scan(spark, paths, ["MVT_ID_mvt"]).withColumnRenamed("MVT_ID_mvt", "id")
    assert write_checked(df, str(tmp_path / "checked")).count() == 5
    write_parquet(df, str(tmp_path / "plain"))
    assert any(".zstd." in p.name for p in (tmp_path / "plain").iterdir())


def test_settle_uses_the_named_folder(spark):
    df = settle(spark.range(3), "probe")
    assert df.count() == 3 and shared_dir(spark) in df.inputFiles()[0]


CSV = """#DEBUG: comment
station,valid,tmpf,dwpf,drct,sknt,vsby,gust,wxcodes,skyc1,skyc2,skyc3,skyc4,skyl1,skyl2,skyl3,skyl4
aaa,2025-03-01 11:50,32.0,M,90.00,10.00,6.21,null,-ra BR,FEW,bkn,OVC,,1000,2500,2000,M
AAA,2025-03-01 09:00,50.0,41.0,M,M,M,M,,,,,,,,,
AAA,2025-03-01 09:00,50.0,40.0,M,M,M,M,,,,,,,,,
BBB,2025-03-01 12:01,1.0,1.0,0,0,0,0,TSRA,CLR,,,,,,,
"""


def feed(spark, tmp_path, text=CSV):
    (tmp_path / "feed_1.csv").write_text(text)
    return read_observations(spark, str(tmp_path / "feed_*.csv"))


def test_observations(spark, tmp_path):
    raw = feed(spark, tmp_path)
    obs = clean_observations(raw)
    assert obs.count() == 3 and obs.filter("dwpf = 41").count() == 1
    t = int(dt.datetime(2025, 3, 1, 12, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    rows = spark.createDataFrame([(1, "AAA", t), (2, "BBB", t), (3, "AAA", t + 3 * 3600 * 1_000_000)], "id long, entity string, move_us long")
    out = attach_weather(rows, obs)
    one, two, three = out.orderBy("id").collect()
    assert (one["wx_age_minutes"], one["wx_missing"], one["wx_temp_c"], one["wx_dewpoint_c"], one["wx_freezing"]) == (10.0, 0, 0.0, None, 1)
    assert (one["wx_ceiling_ft"], one["wx_sky_cover"], one["wx_rain"], one["wx_fog_mist"], one["wx_thunder"]) == (2000.0, 4, 1, 1, 0)
    assert one["wx_wind_sin"] == pytest.approx(1.0) and one["wx_visibility_km"] == pytest.approx(6.21 * 1.609344) and one["wx_gust_knots"] is None
    assert two["wx_missing"] == 1 and two["wx_rain"] is None and two["wx_age_minutes"] is None
    assert three["wx_missing"] == 1
    enforce_age(out)
    with pytest.raises(ValueError):
        enforce_age(out.withColumn("wx_age_minutes", F.lit(181.0)))
    assert {r["entity"]: (r["rows"], r["matched"], r["median_age"]) for r in match_audit(out).collect()} == {"AAA": (2, 1, 10.0), "BBB": (1, 0, None)}


def test_feed_check(spark, tmp_path):
    raw = feed(spark, tmp_path).withColumn("station", F.upper("station")).withColumn("line", F.monotonically_increasing_id())
    good = {r["check"]: r["violations"] for r in feed_check(raw, ["AAA", "BBB"], "2025-03-01", "2025-03-02").collect()}
    assert not any(good.values())
    bad = {r["check"]: r["violations"] for r in feed_check(raw, ["AAA", "CCC"], "2025-03-01 10:00", "2025-03-01 12:01", "line").collect()}
    assert bad == {"empty": 0, "unexpected_station": 1, "out_of_range": 3, "absent_AAA": 0, "absent_CCC": 1, "not_sorted": 1}
    with pytest.raises(ValueError):
        clean_observations(raw.drop(FIELDS[2]))


def test_bad_timestamps_stop_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="11-50"):
        clean_observations(feed(spark, tmp_path, CSV.replace("11:50", "11-50"))).collect()


def test_feature_blocks_are_checked(spark):
    base = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, x double")
    good = spark.createDataFrame([(2, 5), (1, None)], "id long, n int")
    out = attach_by_id(base, good)
    assert out.count() == 2
    c = coverage(out, "n", "n").first()
    assert (c["coverage_pct"], c["enough_pct"], c["mean_support"], c["min_support"]) == (50.0, 50.0, 5.0, 5)
    for bad in (good.filter("id = 1"), good.unionByName(good), good.withColumn("id", F.col("id") + 1)):
        with pytest.raises(Exception, match="feature ids differ"):
            attach_by_id(base, bad).collect()
    with pytest.raises(Exception, match="feature ids differ"):
        attach_by_id(base.unionByName(base), good).collect()
    with pytest.raises(ValueError, match="already contains"):
        attach_by_id(base, good.withColumnRenamed("n", "x"))
    dep = spark.createDataFrame([(1, "A", 5), (2, "A", None), (3, None, 5)], "id long, entity string, offblock_us long")
    q = spark.createDataFrame([(1, 0), (2, None), (3, None)], "id long, active_at_start long")
    assert queue_checks(dep, q).first()["ok"]
    assert not queue_checks(dep, q.withColumn("active_at_start", F.lit(-1))).first()["ok"]


def test_audit_tables(spark):
    df = spark.createDataFrame([(1, "DEP", "A", None), (2, "ARR", "A", "x"), (2, "DEP", None, "y")], "id long, phase string, entity string, s string")
    assert {r["column"]: (r["nulls"], r["null_pct"]) for r in null_profile(df).collect()} == {
        "id": (0, 0.0), "phase": (0, 0.0), "entity": (1, 33.333), "s": (1, 33.333)}
    assert {r["column"]: r["distinct_values"] for r in cardinalities(df, ["entity", "s"]).collect()} == {"entity": 2, "s": 3}
    assert {r["column"]: r["distinct_values"] for r in cardinalities(df, ["entity", "s"], approximate=True).collect()} == {"entity": 2, "s": 3}
    assert {(r["entity"], r["DEP"], r["ARR"]) for r in counts_by(df, "entity").collect()} == {("A", 1, 1), (None, 1, 0)}
    assert integrity(df, "id", {"m": ("phase", "entity")}, {"n": "s"}).first().asDict() == {"duplicate_ids": 1, "m": 2, "n": 1}
    diff = schema_difference(df.drop("s").withColumn("extra", F.lit(1)), df)
    assert {(r["change"], r["column"]) for r in diff.collect()} == {("missing", "s"), ("added", "extra")}
    assert usable_columns(df, ["id", "s"], 0.3) == ["id"]
    s = target_summary(spark.createDataFrame([(None,), (0,), (59,), (4000,)], "y int"), "y").first()
    assert (s["rows"], s["target_nulls"], s["le_zero"], s["under_1min"], s["over_60min"], s["median"], s["p50"]) == (4, 1, 1, 2, 1, 59.0, 59)
    p = leakage_probe(spark.createDataFrame([(10_000_000, 5_000_000, None, 5), (9_000_000, 1_000_000, 0, 9)], "m long, a long, b long, y long"), "m", "y",
                      ["a", "b"], F.col("b").isNotNull())
    got = {(r["population"], r["candidate"]): (r["n"], r["coverage_pct"], r["mae"]) for r in p.collect()}
    assert got == {("all", "a"): (2, 100.0, 0.5), ("all", "b"): (1, 50.0, 0.0), ("matched", "a"): (1, 100.0, 1.0), ("matched", "b"): (1, 100.0, 0.0)}
