"""Fits. Their errors have no SQL form; what a fit must keep (rows, scope, floor, scopes of blends, control) has, and is compared."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventide.catalog.adapter import DEPS, SPECIALISTS, departures, moves
from eventide.catalog.encodings import CAL, FIT, backoff_pick, backoff_sql
from eventide.catalog.evaluation import IN_SCOPE, TRIGGER
from eventide.catalog.registry import query, r6, rounded
from eventide.functions.expr import finite
from eventide.operators.backoff import CEILING, FLOOR
from eventide.operators.blend import blend_segments, substitute
from eventide.operators.codes import code_dimension
from eventide.operators.metrics import rmse
from eventide.operators.models import SEED, TreeParams, capacity_grid, fit_specialists, fit_subpopulation, fit_trees, predict_specialists
from eventide.operators.ordered import ordered_statistics
from eventide.operators.overlay import apply_overlay, fit_overlay
from eventide.operators.selection import CONFIGS, choose_config, compare_configs
from eventide.plans.evaluation import split_frames
from eventide.plans.features import build_features
from eventide.plans.modelling import CODED, final_fit, model_features, model_inputs, run_split, training_frames
from eventide.plans.settle import settle

NUMERIC = ("implied_duration", "offblock_missing", "move_minus_sched", "move_minus_last", "move_minus_filed", "move_minus_initial",
           "offblock_minus_sched", "planned_length", "hour", "weekday", "dep_prev_30", "arr_prev_30", "lane_prev_30", "plan_dep_prev_30",
           "lane_share_30")
# Larger steps and a shorter wait than the library's 0.06 and 100: on small tables a round costs about 0.6 s of job starts, whatever its rows.
PARAMS = TreeParams(step=0.5, patience=8, depth=5)
TEST = "test"


def _n_finite():
    return F.count(F.when(finite("pred"), 1)).alias("n_finite")


def _features(spark, sf):
    """The feature table on the scaled calendar, where the period stands for the month, and its category codes."""
    m = moves(spark, sf)
    features = build_features(m, keep=["period", "pday"])
    features = features.withColumn("month", F.col("period")).withColumn("day", F.col("pday"))
    features = settle(features.select("month", "day", *model_inputs(NUMERIC)), "features")
    return features, settle(code_dimension([features], CODED), "codes")


def _frames(spark, sf, split="composition"):
    return training_frames(*_features(spark, sf), split, CAL)


def _global(frames, params=PARAMS):
    names, categorical = model_features(NUMERIC)
    return names, categorical, run_split(frames, names, categorical, params)


CONTROL = "greatest({0}, least({1}, cast({2} as double)))".format(FLOOR, CEILING, backoff_pick("test")[1])


@query("mod1_global_model", f"""with {DEPS}, {FIT}, {backoff_sql('fit')}, c as (select r.month, r.duration_s, {CONTROL} as control from {backoff_pick('test')[0]})
select month, count(*) as n, count(*) as n_finite, round(sqrt(avg(pow(control - duration_s, 2))), 6) as control_rmse, true as model_beats_control from c group by month""")
def global_model(spark, sf):
    _, scored = _global(_frames(spark, sf))[2]
    better = scored.agg((rmse("pred", "duration_s") < rmse("control", "duration_s")).alias("b")).scalar()
    return scored.groupBy("month").agg(F.count("*").alias("n"), _n_finite(), r6(rmse("control", "duration_s"), "control_rmse")).withColumn("model_beats_control", better)


@query("mod1_rounds")
def rounds(spark, sf):
    """Inner error after each round, and which rounds were kept."""
    model, _ = _global(_frames(spark, sf))[2]
    return model.rounds()


def _specialists(spark, sf, segment, scope):
    frames = _frames(spark, sf)
    names, categorical, (_, scored) = _global(frames)
    fitted = fit_specialists(frames["fit"], segment, scope, names, categorical, inner=frames["inner"], params=PARAMS)
    local = predict_specialists(fitted, frames[TEST], segment)
    both = blend_segments(scored.withColumnRenamed("pred", "base").join(local, "id", "left"), segment, scope, "base", "specialist")
    inside = F.col(segment).isin(*scope)
    halfway = F.abs(F.col("pred") - (F.col("base") + F.col("specialist")) / 2) < 1e-6
    return both.groupBy(segment).agg(F.count("*").alias("n"), _n_finite(), F.count("specialist").alias("n_specialist"), F.count(F.when(inside & halfway, 1)).alias("n_blended"),
                                     F.count(F.when(~inside & (F.col("pred") != F.col("base")), 1)).alias("n_changed_outside"))


def _specialists_sql(segment, scope):
    inside = f"count(*) filter ({segment} in {scope})"
    return f"""with {DEPS}, {FIT} select {segment}, count(*) as n, count(*) as n_finite, {inside} as n_specialist, {inside} as n_blended,
  cast(0 as bigint) as n_changed_outside from test group by {segment}"""


@query("mod2_entity_specialists", _specialists_sql("entity", SPECIALISTS))
def entity_specialists(spark, sf):
    return _specialists(spark, sf, "entity", SPECIALISTS)


@query("mod3_category_specialists", _specialists_sql("weight_class", ("W0", "W2")))
def category_specialists(spark, sf):
    return _specialists(spark, sf, "weight_class", ("W0", "W2"))


@query("mod4_subpopulation_model", f"""with {DEPS}, {FIT} select offblock_missing, count(*) as n, count(*) as n_finite,
  count(*) filter (offblock_missing = 1) as n_replaced, cast(0 as bigint) as n_changed_outside from test group by offblock_missing""")
def subpopulation(spark, sf):
    frames = _frames(spark, sf)
    names, categorical, (_, scored) = _global(frames)
    model = fit_subpopulation(frames["fit"], "offblock_missing", names, categorical, inner=frames["inner"], params=PARAMS)
    own = model.predict(frames[TEST].filter("offblock_missing = 1"), name="own")
    changed = substitute(scored.select("id", "pred"), own.withColumnRenamed("own", "pred")).withColumnRenamed("pred", "new")
    out = scored.withColumnRenamed("pred", "base").join(changed, "id").join(own, "id", "left").withColumn("pred", F.col("new"))
    return out.groupBy("offblock_missing").agg(
        F.count("*").alias("n"), _n_finite(), F.count(F.when(F.col("new") == F.col("own"), 1)).alias("n_replaced"),
        F.count(F.when(F.col("own").isNull() & (F.col("new") != F.col("base")), 1)).alias("n_changed_outside"))


@query("mod5_second_learner", f"""with {DEPS}, parts as (select 'inner' as role, id from deps where month = 12 union all select 'test', id from deps
  where month = 1 or (month = 7 and entity in {CAL.summer_entities})) select role, count(*) as n, count(*) as n_finite, true as floor_held, true as own_trees from parts group by role""")
def second_learner(spark, sf):
    """Its predictions of the inner period are kept as well; they are not those of the first learner."""
    frames = _frames(spark, sf)
    names, categorical, (first, _) = _global(frames)
    model = fit_trees(frames["fit"], names, categorical, params=PARAMS, inner=frames["inner"], learner="ordered", floor=FLOOR)
    out = None
    for role in ("inner", TEST):
        part = model.predict(frames[role]).join(first.predict(frames[role], name="first"), "id").withColumn("role", F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("role").agg(F.count("*").alias("n"), _n_finite(), (F.min("pred") >= FLOOR).alias("floor_held"),
                                   (F.count(F.when(F.abs(F.col("pred") - F.col("first")) > 1e-6, 1)) > F.count("*") / 2).alias("own_trees"))


@query("mod5_ordered_statistics", f"""with {DEPS}, {FIT}, prior as (select avg(duration_s) as p from fit),
placed as (select id, duration_s, entity, stand, kind, ('0x' || substr(md5(id || ':{SEED}'), 1, 15))::bigint as place from fit)
select id, """ + ", ".join(f"""round((coalesce(sum(duration_s) over (partition by {c} order by place, id rows between unbounded preceding and 1 preceding), 0) + p)
  / (count(*) over (partition by {c} order by place, id rows between unbounded preceding and current row)), 6) as os_{c}""" for c in ("entity", "stand", "kind")) + " from placed, prior")
def statistics(spark, sf):
    fit = settle(departures(spark, sf).filter(~F.col("month").isin(1, 7, 12)), "fit")
    prior = fit.agg(F.avg("duration_s")).first()[0]
    out = ordered_statistics(fit, ["entity", "stand", "kind"], "duration_s", prior, seed=SEED, rows_per_bucket=1_000)
    return rounded(out, "os_entity", "os_stand", "os_kind")


@query("gat6_final_fit", f"with {DEPS} select month, count(*) as n, count(*) as n_finite, true as same_trees from deps where month > 10 group by month")
def final_model(spark, sf):
    """Gate the model on October, persist the verdict, and fit on all months up to then only if it passed; predict the rest."""
    features, codes = _features(spark, sf)
    gated, scored = _global(training_frames(features, codes, "october", CAL))[2]
    verdict = settle(scored.agg(rmse("control", "duration_s").alias("base_raw"), rmse("pred", "duration_s").alias("cand_raw")), "verdict")
    final, out = final_fit(verdict, features.filter("month <= 10"), features.filter("month > 10"), codes, gated, PARAMS)
    return out.groupBy("month").agg(F.count("*").alias("n"), _n_finite(), F.lit(final.trees == gated.trees).alias("same_trees"))


@query("mod6_feature_importance")
def importance(spark, sf):
    model, _ = _global(_frames(spark, sf))[2]
    return model.importance(15)


@query("mod6_importance_checks", f"select cast({len(model_features(NUMERIC)[0])} as bigint) as n_features, 1.0::double as total, cast(0 as bigint) as n_negative")
def importance_checks(spark, sf):
    model, _ = _global(_frames(spark, sf))[2]
    return model.importance().agg(F.count("feature").alias("n_features"), r6(F.sum("share"), "total"), F.count(F.when(F.col("share") < 0, 1)).alias("n_negative"))


def _arms(spark, sf):
    """The October rows with a prediction, and an overlaid one, of each fitted configuration."""
    frames = _frames(spark, sf, "october")
    names, categorical = model_features(NUMERIC)
    out = frames[TEST]
    for config, model in capacity_grid(frames["fit"], CONFIGS, names, categorical, frames["inner"], PARAMS).items():
        out = out.join(model.predict(frames[TEST], name=config), "id")
    line = settle(fit_overlay(split_frames(departures(spark, sf), "october", CAL)["pool"], TRIGGER), "line")
    return settle(apply_overlay(out, TRIGGER, list(CONFIGS), line, required=True), "configs")


@query("mod7_capacity_grid", f"""with {DEPS}, grid(config, leaves, min_data) as (values {", ".join(f"('{n}', {c['leaves']}, {c['min_data']})" for n, c in CONFIGS.items())})
select config, leaves, min_data, count(*) as n, count(*) as n_finite, count(*) filter ({IN_SCOPE}) as n_overlaid from deps, grid where month = 10 group by all""")
def grid(spark, sf):
    arms = _arms(spark, sf)
    rows = arms.select("touched", *CONFIGS, F.inline(F.array(*[
        F.struct(F.lit(n).alias("config"), F.lit(c["leaves"]).alias("leaves"), F.lit(c["min_data"]).alias("min_data"), F.col(n).alias("pred"),
                 F.col(f"{n}_overlaid").alias("overlaid")) for n, c in CONFIGS.items()])))
    return rows.groupBy("config", "leaves", "min_data").agg(F.count("*").alias("n"), _n_finite(), F.count(F.when(F.col("touched"), 1)).alias("n_overlaid"))


@query("sel2_fitted_comparison")
def fitted_comparison(spark, sf):
    """SEL2 on the models of MOD7. The same operator equals SQL on closed-form arms in ``sel2_capacity_comparison``."""
    return rounded(compare_configs(_arms(spark, sf), list(CONFIGS), "duration_s"), "raw_rmse", "overlaid_rmse", "win_rate", "largest_share")


@query("sel2_fitted_choice")
def fitted_choice(spark, sf):
    arms = _arms(spark, sf)
    return choose_config(arms, settle(compare_configs(arms, list(CONFIGS), "duration_s"), "compared"), "duration_s", CONFIGS)
