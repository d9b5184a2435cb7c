"""Ties, edges, nulls and dense groups of the event-time operators, against brute force."""
import random

import pytest
from pyspark.sql import functions as F

from eventide.functions.clock import HOUR_US, MINUTE_US
from eventide.operators.asof import asof_attach
from eventide.operators.prefix import suited_width
from eventide.operators.neighborhood import (completed_state, congestion, frame_sums, overlapping_intervals, prior,
                                             prior_closed, following)

MOVE = ("id long, phase string, entity string, lane string, move_us long, sched_us long, block_us long, "
        "offblock_us long, duration_s long, period int")
T = 1_700_000_000_000_000 // MINUTE_US * MINUTE_US


def moves(spark, rows):
    full = []
    for r in rows:
        base = dict(phase="DEP", entity="E", lane="L", sched_us=None, block_us=None, offblock_us=None, duration_s=None, period=1)
        base.update(r)
        full.append(tuple(base[c] for c in ("id", "phase", "entity", "lane", "move_us", "sched_us", "block_us", "offblock_us",
                                            "duration_s", "period")))
    return spark.createDataFrame(full, MOVE)


def by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def test_congestion_edges(spark):
    w = 15 * MINUTE_US
    out = by_id(congestion(moves(spark, [
        dict(id=1, move_us=T), dict(id=2, move_us=T),                      # tie
        dict(id=3, move_us=T - w), dict(id=4, move_us=T + w),              # exactly t - w is out, t + w is in
        dict(id=5, move_us=T, lane=None), dict(id=6, phase="ARR", move_us=T - w + 1),
        dict(id=7, move_us=T, entity=None), dict(id=8, move_us=T, entity="LONELY", sched_us=T),
    ])))
    assert set(out) == {1, 2, 3, 4, 5, 7, 8}
    a = out[1]
    assert (a["dep_prev_15"], a["dep_next_15"], a["arr_prev_15"], a["arr_next_15"]) == (3, 1, 1, 0)
    assert a["dep_prev_30"] == 4 and a["lane_prev_15"] == 2 and a["lane_prev_30"] == 3
    assert a["plan_dep_prev_30"] is None
    assert a["lane_share_30"] == pytest.approx(3 / 4)
    assert out[5]["lane_prev_15"] is None and out[5]["dep_prev_15"] == 3
    assert out[7]["dep_prev_15"] is None
    assert (out[8]["dep_next_30"], out[8]["dep_prev_60"], out[8]["plan_dep_prev_30"], out[8]["plan_dep_next_30"]) == (0, 1, 1, 0)


@pytest.mark.parametrize("width", [MINUTE_US, 7 * MINUTE_US, 24 * HOUR_US])
def test_frame_sums_do_not_depend_on_bucket_width(spark, width):
    rnd = random.Random(5)
    ev = [(rnd.choice("AAAB"), T + rnd.randrange(0, 4 * 3600) * 1_000_000 // 7, rnd.randrange(9), rnd.random() < .5) for _ in range(400)]
    frames = [prior("p", 10), following("n", 20), prior_closed("c", 10)]
    df = spark.createDataFrame(ev, "k string, at long, v long, ask boolean").repartition(5)
    got = {(r["k"], r["at"]): (r["v_p"], r["v_n"], r["v_c"]) for r in
           frame_sums(df, ["k"], "at", {"v": "v"}, frames, "ask", width).collect()}

    def total(k, t, lo, hi):
        return sum(v for kk, at, v, _ in ev if kk == k and t + lo < at <= t + hi)

    want = {(k, t): tuple(total(k, t, f.after_us, f.until_us) for f in frames) for k, t, _, ask in ev if ask}
    assert got == want


def test_frame_sums_before_the_epoch(spark):
    df = spark.createDataFrame([("k", -3), ("k", -1), ("k", 0), ("k", 2)], "k string, at long")
    out = {r["at"]: r["n_p"] for r in frame_sums(df, ["k"], "at", {"n": "1"}, [prior("p", 1)], width_us=2).collect()}
    assert out == {-3: 1, -1: 2, 0: 3, 2: 4}


def test_completed_state_is_inclusive_at_both_ends(spark):
    h = 60 * MINUTE_US
    out = by_id(completed_state(moves(spark, [
        dict(id=1, move_us=T), dict(id=2, move_us=T + 2 * h), dict(id=3, move_us=T, entity=None),
        dict(id=10, phase="ARR", move_us=T - h, block_us=T, duration_s=100),
        dict(id=11, phase="ARR", move_us=T - h, block_us=T - h, duration_s=50),
        dict(id=12, phase="ARR", move_us=T - h, block_us=T - h - 1, duration_s=9999),
        dict(id=13, phase="ARR", move_us=T - h, block_us=T - 5, duration_s=None),
    ])))
    assert (out[1]["done_mean_60"], out[1]["done_n_60"]) == (75.0, 2)
    assert (out[2]["done_mean_60"], out[2]["done_n_60"]) == (None, None)
    assert (out[3]["done_mean_60"], out[3]["done_n_60"]) == (None, None)


def test_overlaps_dense(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(300):
        s = None if rnd.random() < .1 else T + rnd.randrange(0, 1800) * 1_000_000
        e = None if rnd.random() < .05 else (s or T) + rnd.choice([-60, 0, 30, 600, 3600]) * 1_000_000
        rows.append(dict(id=i, entity=rnd.choice(["A", "A", "B", None]), offblock_us=s, move_us=e, period=rnd.choice([1, 2])))
    got = {k: v["active_at_start"] for k, v in by_id(overlapping_intervals(moves(spark, rows), ["period"], width_us=5 * MINUTE_US)).items()}

    def active(q):
        if q["offblock_us"] is None or q["entity"] is None:
            return None
        return sum(1 for o in rows if o["id"] != q["id"] and o["entity"] == q["entity"] and o["period"] == q["period"]
                   and o["offblock_us"] is not None and o["move_us"] is not None and o["move_us"] > o["offblock_us"]
                   and o["offblock_us"] <= q["offblock_us"] < o["move_us"])

    want = {r["id"]: active(r) for r in rows}
    assert got == want
    assert max(v for v in want.values() if v is not None) >= 5


@pytest.mark.parametrize("width", [10 * MINUTE_US, MINUTE_US, 48 * HOUR_US])
def test_asof_edges(spark, width):
    tol = 3 * HOUR_US
    q = spark.createDataFrame([(1, "A", T), (2, "B", T), (3, "C", T), (4, "D", T), (5, None, T), (6, "A", None), (7, "F", T), (8, "F", T)],
                              "id long, k string, at long")
    o = spark.createDataFrame([("A", T, 1.0, "x"), ("B", T - tol, 2.0, "x"), ("C", T - tol - 1, 3.0, "x"), ("D", T + 1, 4.0, "x"),
                               ("F", T - 7, 1.0, "x"), ("F", T - 7, 1.0, "y"), ("F", T - 8, 99.0, "z")],
                              "k string, seen long, v double, tag string")
    out = by_id(asof_attach(q, o, ["k"], "at", "seen", tol, width))
    assert {i: r["v"] for i, r in out.items()} == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: None, 6: None, 7: 1.0, 8: 1.0}
    assert out[7]["tag"] == out[8]["tag"] == "y"


def test_asof_random_against_brute_force(spark):
    rnd = random.Random(3)
    obs = [(rnd.choice("AB"), T + rnd.randrange(0, 86400) * 1_000_000, i) for i in range(60)]
    asks = [(i, rnd.choice("ABC"), T + rnd.randrange(0, 86400) * 1_000_000) for i in range(200)]
    out = by_id(asof_attach(spark.createDataFrame(asks, "id long, k string, at long"),
                            spark.createDataFrame(obs, "k string, seen long, n long"), ["k"], "at", "seen", HOUR_US, 20 * MINUTE_US))

    def best(k, t):
        seen = [(s, n) for kk, s, n in obs if kk == k and t - HOUR_US <= s <= t]
        return max(seen)[1] if seen else None

    assert {i: r["n"] for i, r in out.items()} == {i: best(k, t) for i, k, t in asks}


def test_results_do_not_depend_on_partitions(spark):
    rnd = random.Random(8)
    rows = [dict(id=i, phase=rnd.choice(["DEP", "ARR"]), entity=rnd.choice("AAAAAB"), lane=rnd.choice("12"),
                 move_us=T + rnd.randrange(3600) * 1_000_000, sched_us=T + rnd.randrange(3600) * 1_000_000) for i in range(250)]
    results = []
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(by_id(congestion(moves(spark, rows).repartition(3))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] == results[2]


def test_scopes_are_separate_universes(spark):
    rows = [dict(id=1, move_us=T, period=1), dict(id=2, move_us=T, period=2), dict(id=3, move_us=T, period=2)]
    out = by_id(congestion(moves(spark, rows), ["period"]))
    assert [out[i]["dep_prev_15"] for i in (1, 2, 3)] == [1, 2, 2]


def test_suited_width_follows_the_densest_key(spark):
    dense = spark.range(6000).select(F.lit("H").alias("k"), (F.col("id") * 10_000 + T).alias("at"))
    thin = spark.range(50).select(F.lit("L").alias("k"), (F.col("id") * HOUR_US + T).alias("at"))
    df = dense.unionByName(thin)
    assert 0.8 < suited_width(df, ["k"], "at", 600) / (MINUTE_US / 10) < 1.25
    assert suited_width(df.limit(0), ["k"], "at") > 0


def test_hot_key_stays_linear(spark):
    """A third of all rows on one key and instant: the log collapses to its instants before ordering."""
    hot = spark.range(30_000).select(F.lit("H").alias("k"), F.lit(T).alias("at"))
    rest = spark.range(60_000).select((F.col("id") % 50).cast("string").alias("k"), (F.col("id") * 1_000_000 + T).alias("at"))
    out = frame_sums(hot.unionByName(rest), ["k"], "at", {"n": "1"}, [prior("p", 15)])
    assert out.filter("k = 'H'").first()["n_p"] == 30_000
    assert out.filter("k <> 'H'").agg(F.max("n_p")).first()[0] == 18
