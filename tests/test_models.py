"""Tree fits: learning, missing values, early stop, specialists, persistence."""
import hashlib
import random

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from eventide.operators.metrics import rmse
from eventide.operators.models import (TreeParams, capacity_grid, category_sizes, feature_set, fit_specialists, fit_subpopulation, fit_trees, load_model, model_rows, predict_specialists,
                                       prepare_fit)
from eventide.operators.ordered import apply_statistics, fit_statistics, ordered_statistics
from eventide.plans.modelling import model_features, model_inputs

QUICK = TreeParams(rounds=8, depth=3, min_rows=2, step=0.4)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    out = []
    for i in range(600):
        x = None if i % 5 == 0 else rnd.uniform(0, 10)
        code = None if i % 11 == 0 else i % 3
        y = 500 if x is None else int(100 * x + (200 if code == 1 else 0))
        out.append((i, "A" if i % 2 else "B", x, code, int(x is None), y))
    return spark.createDataFrame(out, "id long, entity string, x double, code int, missing int, duration_s int").cache()


def test_boosted_fit_learns_and_keeps_missing_apart(spark, rows, tmp_path):
    m = fit_trees(rows, ["x", "code"], ["code"], params=QUICK, floor=60.0)
    scored = rows.join(m.predict(rows), "id")
    spread = rows.agg(F.stddev_samp("duration_s")).first()[0]
    assert scored.agg(rmse("pred", "duration_s")).first()[0] < 0.4 * spread
    assert abs(scored.filter("missing = 1").agg(F.avg("pred")).first()[0] - 500) < 60
    assert scored.agg(F.min("pred")).first()[0] >= 60.0
    top = m.importance(1).first()
    assert top["feature"] == "x" and 0.5 < top["share"] <= 1.0
    m.save(str(tmp_path / "model"))
    again = load_model(str(tmp_path / "model"), m.features, m.categorical, 60.0)
    assert again.predict(rows).join(m.predict(rows, name="p0"), "id").filter("pred <> p0").count() == 0


def test_missing_values_of_a_feature_vector(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, 0), (3, float("nan"), 7)], "id long, x double, code int")
    vector = lambda **how: {r["id"]: (r["x"], r["code"]) for r in model_rows(df, ["x", "code"], {"code": 2}, ["id"], **how).collect()}
    sentinel = vector(missing=-1e9)
    assert sentinel[1] == (-1e9, 0.0) and sentinel[2] == (3.0, 1.0)
    assert repr(vector()[1]) == "(nan, 0.0)"


def test_patience_keeps_the_best_round(spark, rows):
    fit, inner = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0").withColumn("duration_s", F.col("duration_s") + (F.hash("id") % 150))
    how = dict(depth=3, min_rows=2, step=0.4)
    ready = prepare_fit(fit, ["x", "code"], ["code"], inner=inner)
    m = ready.fit(TreeParams(patience=5, **how))
    best = min(range(len(m.errors)), key=m.errors.__getitem__) + 1
    assert m.stopped and m.trees == best and len(m.errors) == best + 5 < 3000
    assert [r.kept for r in m.rounds().orderBy("round").collect()] == [k < best for k in range(len(m.errors))]
    got = inner.join(m.predict(inner), "id").agg(rmse("pred", "duration_s")).first()[0]
    assert got == pytest.approx(m.errors[best - 1])
    # a limit below the wait ends the fit without patience; the first rounds are those of the longer fit
    short = ready.fit(TreeParams(rounds=4, patience=5, **how))
    assert not short.stopped and short.errors == pytest.approx(m.errors[:4])
    with pytest.raises(ValueError, match="inner"):
        fit_trees(fit, ["x"], [], params=QUICK, inner=inner.limit(0))


def test_first_stage_is_no_longer_than_twice_the_wait(spark, rows, monkeypatch):
    tried, set_rounds = [], GBTRegressor.setMaxIter
    monkeypatch.setattr(GBTRegressor, "setMaxIter", lambda self, n: tried.append(n) or set_rounds(self, n))
    m = fit_trees(rows.filter("id % 4 <> 0"), ["x", "code"], ["code"], params=TreeParams(patience=5, depth=2, min_rows=2, step=1.0),
                  inner=rows.filter("id % 4 = 0").withColumn("duration_s", 1000 - F.col("duration_s")))
    assert m.stopped and m.trees <= 5 and tried == [10]


def test_inputs_of_the_models_cover_what_is_read():
    names, categorical = model_features(["planned_length"])
    inputs = model_inputs(["planned_length"])
    assert len(inputs) == len(set(inputs)) and {"id", "duration_s", "planned_length", "entity", "stand", "dest", "operator", "weekday"} <= set(inputs)
    assert {c.removesuffix("_code") for c in categorical} <= set(inputs) and "dep_next_15" not in inputs


def test_inner_rows_are_never_trained_on(spark, rows):
    inner = rows.withColumn("duration_s", F.lit(10_000))
    m = fit_trees(rows, ["x", "code"], ["code"], params=TreeParams(rounds=30, patience=5, depth=3, min_rows=2, step=0.4), inner=inner)
    assert m.predict(rows).agg(F.max("pred")).first()[0] < 3000


def test_specialists_and_subpopulation(spark, rows):
    models = fit_specialists(rows, "entity", ("A",), ["x", "code"], ["code"], params=QUICK)
    out = predict_specialists(models, rows, "entity")
    assert out.count() == rows.filter("entity = 'A'").count()
    with pytest.raises(ValueError):
        fit_specialists(rows, "entity", ("Z",), ["x"], [], params=QUICK)
    sub = fit_subpopulation(rows, "missing", ["x", "code", "missing"], ["code"], params=QUICK)
    assert sub.features == ["code"]


def test_second_learner_and_feature_toggles(spark, rows, tmp_path):
    how = dict(params=TreeParams(rounds=5, depth=4, min_rows=2))
    m, first = fit_trees(rows, ["x", "code"], ["code"], learner="ordered", **how), fit_trees(rows, ["x", "code"], ["code"], **how)
    assert m.trees == 5 and m.ordered == ["code"] and first.ordered == []
    assert m.predict(rows).join(first.predict(rows, name="other"), "id").filter("abs(pred - other) > 1e-6").count() > 300
    m.save(str(tmp_path / "model"))
    again = load_model(str(tmp_path / "model"), m.features, m.categorical)
    assert again.predict(rows).join(m.predict(rows, name="p0"), "id").filter("pred <> p0").count() == 0
    with pytest.raises(ValueError):
        fit_trees(rows, ["x"], [], learner="other")
    assert feature_set(["a", "b"], [["c"]], ["b"], ["a", "c"]) == ["a", "c"]
    with pytest.raises(ValueError, match="missing: c"):
        feature_set(["a"], [["c"]], available=["a"])
    assert TreeParams.from_capacity(127, 200).depth == 7 and TreeParams.from_capacity(255, 50).min_rows == 50


def test_kind_of_a_column_does_not_depend_on_rows(spark):
    for n in (20, 3000):
        df = spark.range(n).selectExpr("id", "cast(id % 40 as int) as count_col", "cast(id % 50 as int) as code", "cast(id % 7 as double) as duration_s")
        m = fit_trees(df, ["count_col", "code"], ["code"], params=TreeParams(rounds=1, depth=2, min_rows=1))
        assert set(m.sizes) == {"code"} and m.sizes == category_sizes(df, ["code"]) == {"code": min(n, 50) + 1}
        assert m.predict(spark.createDataFrame([(1, None, 999)], "id long, count_col int, code int")).count() == 1


def test_capacities_keep_their_depth():
    from eventide.operators.selection import CONFIGS
    depths = {TreeParams.from_capacity(c["leaves"], c["min_data"]) for c in CONFIGS.values()}
    assert len(depths) == len({(p.depth, p.min_rows) for p in depths}) > 2


def test_wide_category_changes_no_other_bins(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 7 as double) as x", "cast(id % 3 as int) as code", "cast(id % 7 * 10 as double) as duration_s")
    wide = df.withColumn("code", F.when(F.col("id") == 5, 5000).otherwise(F.col("code")))
    p = prepare_fit(wide, ["x", "code"], ["code"])
    assert p.ordered == ["code"] and p.bins == 64 and p.matrix.count() == 300
    q = prepare_fit(df, ["x", "code"], ["code"])
    assert q.ordered == [] and q.matrix.count() == 300
    assert p.fit(TreeParams(rounds=2, depth=3)).predict(wide).count() == 300


def test_grid_fits_from_one_matrix(spark, rows):
    fitted = capacity_grid(rows.filter("id % 4 <> 0"), {"small": {"leaves": 3, "min_data": 2}, "large": {"leaves": 15, "min_data": 2}}, ["x", "code"], ["code"],
                           rows.filter("id % 4 = 0"), TreeParams(rounds=6, patience=2, step=0.4))
    assert set(fitted) == {"small", "large"}
    assert fitted["large"].errors != fitted["small"].errors


def test_ordered_statistics_equal_a_loop(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice(["hot"] * 8 + ["b", None]), rnd.choice("xy"), rnd.choice([None, *range(20)])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, a string, b string, y long")
    want = {}
    for column in (1, 2):
        seen = {}
        for r in sorted((d for d in data if d[3] is not None), key=lambda d: (int(hashlib.md5(f"{d[0]}:9".encode()).hexdigest()[:15], 16), d[0])):
            total, n = seen.get(r[column], (0, 0))
            want.setdefault(r[0], []).append((total + 2 * 7.5) / (n + 2))
            seen[r[column]] = (total + r[3], n + 1)
    for size in (10, 10**6):
        got = {r.id: [r.os_a, r.os_b] for r in ordered_statistics(df, ["a", "b"], "y", 7.5, seed=9, strength=2.0, rows_per_bucket=size).collect()}
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)
    stats = fit_statistics(df, ["a"], "y", 7.5, strength=2.0)
    new = apply_statistics(spark.createDataFrame([(1, None), (2, "unseen"), (3, "hot")], "id long, a string"), stats, ["a"], 7.5)
    hot = [d[3] for d in data if d[1] == "hot" and d[3] is not None]
    assert {r.id: r.os_a for r in new.collect()}[3] == pytest.approx((sum(hot) + 15) / (len(hot) + 2))
    assert {r.id: r.os_a for r in new.collect()}[2] == 7.5 and new.count() == 3
