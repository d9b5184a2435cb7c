"""Checks that ride on the rows: what they let through, what stops the job, and that they cost no second pass."""
import random

import pytest
from pyspark.sql import functions as F

from eventide.operators.blend import blend, recombine
from eventide.operators.contracts import contracted, join_complete, join_many_to_one, join_one_to_one
from eventide.operators.overlay import Trigger, calibrate, stability
from eventide.operators.places import with_place
from eventide.plans.evaluation import publish
from eventide.sources.files import _id_tally, write_checked
from eventide.sources.observations import FIELDS, attach_weather, clean_observations, feed_check

P = "id long, pred double"


def frame(spark, rows, schema=P):
    return spark.createDataFrame(rows, schema)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def stored(spark, tmp_path, name, rows, schema):
    frame(spark, rows, schema).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_a_contract_names_what_is_wrong(spark):
    assert contracted(frame(spark, [(1, 2.0), (2, 3.0)]), ["pred"]).count() == 2
    assert contracted(frame(spark, []), ["pred"]).count() == 0
    for rows in ([(None, 1.0)], [(1, None)], [(1, float("nan"))], [(1, float("inf"))]):
        with pytest.raises(Exception, match="null id or non-finite"):
            contracted(frame(spark, rows), ["pred"]).collect()
    with pytest.raises(Exception, match="not unique"):
        contracted(frame(spark, [(1, 1.0), (1, 1.0)]), ["pred"]).collect()
    with pytest.raises(ValueError, match="missing columns"):
        contracted(frame(spark, [(1, 1.0)]), ["other"])


def test_checked_joins(spark):
    left, right = frame(spark, [(1, 1.0), (1, 2.0), (3, 3.0), (None, 4.0)]), frame(spark, [(1, "a"), (2, "b")], "id long, v string")
    got = sorted((r["pred"], r["v"]) for r in join_many_to_one(left, right, ["id"]).collect())
    assert got == [(1.0, "a"), (2.0, "a"), (3.0, None), (4.0, None)]
    assert join_many_to_one(left, right.unionByName(frame(spark, [(None, "x"), (None, "y")], "id long, v string")), ["id"]).count() == 4
    for twice in ([(1, "a"), (1, "b")], [(9, "a"), (9, "b")]):  # found on both sides, on the right only
        with pytest.raises(Exception, match="right side is not unique"):
            join_many_to_one(left, frame(spark, twice, "id long, v string"), ["id"]).collect()
    with pytest.raises(Exception, match="left side is not unique"):
        join_one_to_one(left, right, ["id"]).collect()
    assert join_one_to_one(left.filter("pred > 1"), right, ["id"]).count() == 3
    ok = frame(spark, [(1, 1.0), (2, 2.0)])
    assert sorted(tuple(r) for r in join_complete(ok, right).collect()) == [(1, 1.0, "a"), (2, 2.0, "b")]
    assert join_complete(ok, right.unionByName(frame(spark, [(7, "x"), (7, "y")], "id long, v string"))).count() == 2  # repeated, but not asked for
    for bad in (left, frame(spark, [(4, 1.0)])):
        with pytest.raises(Exception, match="row mismatch"):
            join_complete(bad, right).collect()
    with pytest.raises(Exception, match="row mismatch"):
        join_complete(ok, right.unionByName(right)).collect()


def test_each_input_is_scanned_once(spark, tmp_path):
    a = stored(spark, tmp_path, "a", [(1, 1.0), (2, 2.0)], P)
    b = stored(spark, tmp_path, "b", [(1, "x"), (2, "y")], "id long, v string")
    c = stored(spark, tmp_path, "c", [(1, "A", 10.0, 30.0, 20.0, 15.0)], "id long, entity string, old double, new double, s double, kept double")
    for df, n in ((join_many_to_one(a, b, ["id"]), 2), (join_one_to_one(a, b, ["id"]), 2), (join_complete(a, b), 2), (contracted(a, ["pred"]), 1),
                  (blend(a, a.withColumnRenamed("pred", "pred")), 2), (recombine(c, "entity", ("A",), "old", "new", "s", "kept"), 1)):
        assert scans(df) == n
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    join_one_to_one(a, b, ["id"])  # building the plan starts no job
    assert len(jobs.getJobIdsForGroup()) == before


def test_blends_take_finite_values_only(spark):
    for v in (None, float("nan"), float("inf")):
        for pair in (([(1, v)], [(1, 1.0)]), ([(1, 1.0)], [(1, v)])):
            with pytest.raises(Exception, match="not finite"):
                blend(*[frame(spark, p) for p in pair]).collect()


def test_checked_writes(spark, tmp_path):
    df = frame(spark, [(1, 1.0), (1, 2.0), (None, 3.0)])
    assert write_checked(df, str(tmp_path / "some")).count() == 3
    assert write_checked(df.limit(0), str(tmp_path / "none")).count() == 0
    tally = lambda ids: frame(spark, [(i, 0.0) for i in ids]).agg(*_id_tally("id")).first()
    assert tally([1, 2, 3]) == tally([3, 1, 2])
    assert len({tuple(tally(i)) for i in ([1, 2], [1, 3], [1, 1, 2], [1, 1, 1, 2], [1, 2, 2], [1, 2, None], [])}) == 7

    # Each evaluation draws new ids: ids that are computed a second time for the check would not agree with the file.
    drawn = spark.range(1000).select(F.expr("uuid()").alias("id"))
    assert write_checked(drawn, str(tmp_path / "drawn")).count() == 1000


def test_order_of_a_feed_is_folded(spark):
    """Against the row before, for sequences of any span, with gaps, ties and unreadable times."""
    rng = random.Random(5)
    for lines in ([], [7], list(range(-60, 60)), sorted(rng.sample(range(-(2**40), 2**40), 200)), [-(2**62), 0, 5_000_000, 5_000_001, 2**62]):
        minutes = [rng.randrange(60) for _ in lines]
        unread = [rng.random() < 0.2 for _ in lines]
        rows = [(n, "AAA", None if u else f"2025-03-01 10:{m:02d}") for n, m, u in zip(lines, minutes, unread)]
        raw = frame(spark, rows, "line long, station string, valid string").select("*", *[F.lit("M").alias(f) for f in FIELDS[2:]])
        kept = [m for m, u in zip(minutes, unread) if not u]
        want = sum(b < a for a, b in zip(kept, kept[1:]))
        got = {r["check"]: r["violations"] for r in feed_check(raw, ["AAA"], "2025-03-01", "2025-03-02", "line").collect()}
        assert got["not_sorted"] == want and got["out_of_range"] == sum(unread) and got["empty"] == (not lines)
    with pytest.raises(ValueError, match="wxcodes"):
        feed_check(raw.drop("wxcodes"), ["AAA"], "2025-03-01", "2025-03-02")


def test_weather_needs_an_entity(spark):
    obs = clean_observations(frame(spark, [("AAA", "2025-03-01 10:00", *["M"] * 15)], ", ".join(f"{f} string" for f in FIELDS)))
    with pytest.raises(Exception, match="no entity"):
        attach_weather(frame(spark, [(1, None, 0)], "id long, entity string, move_us long"), obs).collect()


def test_places(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    got = {r["id"]: r["place"] for r in with_place(frame(spark, rows, "id long, k int").repartition(5), [F.desc_nulls_last("k"), "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}
    assert with_place(frame(spark, [], "id long"), ["id"]).count() == 0


def test_stability_lists_quiet_months_and_drops_rare_entities(spark):
    rows = [("A", 1, 1, 2000.0, 1990), ("A", 1, 1, 3000.0, 3100), ("A", 3, 1, 100.0, 100), ("B", 2, 1, 5000.0, 1), ("A", 4, 0, 9000.0, 1), ("B", 2, 1, None, 1)]
    df = frame(spark, rows, "entity string, month int, offblock_missing int, move_minus_sched double, duration_s long")
    got = {r["month"]: (r["triggered"], r["worst_abs"], r["median_abs"], r["within_60s"]) for r in stability(df, Trigger(("A",), 1000), "month", range(1, 5)).collect()}
    assert got == {1: (2, 100.0, 55.0, 50.0), **{m: (0, None, None, None) for m in (2, 3, 4)}}
    assert [r["entity"] for r in stability(df, Trigger(None, 1000), "entity", min_rows=2).collect()] == ["A"]


def test_calibration_guards(spark):
    held = frame(spark, [("A", float(i), 2.0 * i) for i in range(30)] + [("C", 4.0, float(i)) for i in range(30)], "entity string, pred double, y double")
    ask = lambda *rows: calibrate(frame(spark, list(rows), "entity string, pred double"), held, "pred", "y", min_rows=30, entities=("A",))
    assert ask(("A", 3.0)).first()["pred_calibrated"] == pytest.approx(6.0)
    for bad in (("A", None), ("A", float("nan")), ("A", float("inf"))):
        with pytest.raises(Exception, match="not finite"):
            ask(("A", 1.0), bad).collect()
    for bad in ("B", "C"):  # never seen; one prediction only, so no line
        with pytest.raises(Exception, match="insufficient calibration rows"):
            ask(("A", 1.0), (bad, 1.0)).collect()
    with pytest.raises(ValueError, match="no rows to calibrate"):
        ask(("C", 1.0))


def test_an_output_is_published_only_when_everything_holds(spark):
    scored = frame(spark, [(1, "A", 0, 0.0, 100.0, 200.0), (2, "B", 0, 0.0, 100.0, 200.0)],
                   "id long, entity string, offblock_missing int, move_minus_sched double, base double, specialist double")
    template = frame(spark, [(1, None), (2, None)], "id long, duration_s int")
    line, median = frame(spark, [(30, 0.0, 1.0)], "n long, intercept double, slope double"), frame(spark, [(70.0,)], "m double")
    verdict = lambda ok: frame(spark, [("g", ok)], "label string, passed boolean")
    run = lambda s=scored, t=template, scope=("A",), v=verdict(True): publish(s, t, Trigger(("X",)), line, median, scope, v)
    assert {r["id"]: r["duration_s"] for r in run().collect()} == {1: 150, 2: 100}
    assert {r["id"]: r["duration_s"] for r in run(scope=(), v=None).collect()} == {1: 100, 2: 100}
    with pytest.raises(ValueError, match="not permitted"):
        run(v=verdict(False))
    with pytest.raises(ValueError, match="need the verdict"):
        run(v=None)
    with pytest.raises(Exception, match="non-finite"):
        run(scored.withColumn("base", F.lit(float("nan"))))
    with pytest.raises(Exception, match="not unique"):
        run(scored.unionByName(scored))
    with pytest.raises(ValueError, match="not safe to publish"):
        run(t=template.unionByName(template))
