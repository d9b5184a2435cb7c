"""Metrics, bootstrap, overlays, calibration, gates and selection on predictions that SQL can rebuild."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventide.catalog.adapter import DEPS, SCOPE, SPECIALISTS, departures, table
from eventide.catalog.encodings import CAL, ROLE_SQL, SUMMER, backoff_pick, backoff_sql, map_sql
from eventide.catalog.registry import query, r6, rounded
from eventide.operators.bootstrap import paired_bootstrap, poisson_steps
from eventide.operators.backoff import CEILING, FLOOR
from eventide.operators.encoding import Spec
from eventide.operators.gates import KEEP_REPLICATES, invariance, overlay_gate, plain_gate, require_better, slice_table
from eventide.operators.metrics import (error_concentration, error_metrics, largest_row_share, sliced_rmse,
                                        squared_error, tail_report, worst_slices)
from eventide.operators.overlay import (Trigger, apply_overlay, best_configuration, calibrate, calibration_lines, exposure,
                                        fit_line, fit_overlay, leave_one_month_out, stability, sweep)
from eventide.operators.selection import (CONFIGS, adopt_members, choose_config, compare_configs, select_members)
from eventide.plans.evaluation import closed_form_predictions, scored_rows, scored_split, split_frames
from eventide.plans.settle import settle

TRIGGER = Trigger(SCOPE, threshold=3600)
WIDE = Trigger(None, threshold=3600)
LIMITS = (2700, 3000, 3600, 4500, 5400)
SPEC = Spec("te_lane_hour", ("entity", "lane", "hour"))
IN_SCOPE = f"(entity in {SCOPE} and offblock_missing = 1 and move_minus_sched > 3600)"
ANYWHERE = "(offblock_missing = 1 and move_minus_sched > {t})"
SEGMENTS = str(SPECIALISTS)


def scored_sql(fit: str, rows: str) -> str:
    """CTE scored(id, ..., base, cand) with the two closed-form predictors."""
    joins, value = backoff_pick("rws")
    return f"""fit as (select * from deps where {fit}), rws as (select * from deps where {rows}),
{backoff_sql('fit')}, {map_sql(SPEC, 'fit', 'te')},
based as (select r.*, greatest({FLOOR}, least({CEILING}, cast({value} as double))) as base from {joins}),
scored as (select b.*, te.v as enc, case when b.entity in {SEGMENTS} and te.v is not null then 0.5::double * base + 0.5::double * te.v else base end as cand
  from based b left join te on te.entity = b.entity and te.lane = b.lane and te.hour = b.hour)"""


def split_sql(split: str) -> str:
    comp = f"(month = 1 or (month = 7 and entity in {SUMMER}))"
    r = {k: v.format(comp=comp, summer=SUMMER) for k, v in ROLE_SQL[split].items()}
    return scored_sql(r["fit"], r["test"])


POOLS = {"composition": "month not in (1, 7)", "forward": "month <= 5", "seasonal": "day <= 20",
         "december": "month <= 10", "october": "month <= 8"}


def line_sql(split: str) -> str:
    return (f"line as (select count(*) as n, regr_intercept(duration_s, move_minus_sched) as a, "
            f"regr_slope(duration_s, move_minus_sched) as b from deps where {POOLS[split]} and {IN_SCOPE})")


def arms_sql(floor: float | None = None) -> str:
    value = "a + b * move_minus_sched"
    value = f"greatest({floor}, {value})" if floor is not None else value
    return f"""arms as (select s.*, {IN_SCOPE} as touched, case when {IN_SCOPE} then {value} else base end as base_o,
  case when {IN_SCOPE} then {value} else cand end as cand_o from scored s, line),
errs as (select *, pow(base - duration_s, 2) as eb, pow(cand - duration_s, 2) as ec,
  pow(base_o - duration_s, 2) as ebo, pow(cand_o - duration_s, 2) as eco from arms)"""


_STEPS = poisson_steps()
WEIGHT = "case " + " ".join(f"when d < '{s}' then {i}" for i, s in enumerate(_STEPS)) + f" else {len(_STEPS)} end"


def boot_sql(source: str, by: str, values: list[str], replicates: int, tag: str = "boot") -> str:
    """CTE ``<tag>_sums``(by, rep, drawn, sums) with the same draws as the Spark side."""
    sums = ", ".join(f"sum(w * {v}) as {v}" for v in values)
    cols = ", ".join(values)
    return f"""{tag}_draws as (select {by}, {cols}, g * 4 + j as rep,
    substr(md5(cast(id as varchar) || '-' || cast(g as varchar)), cast(8 * j + 1 as int), 8) as d
  from {source}, range(0, {-(-replicates // 4)}) q(g), range(0, 4) p(j)),
{tag}_sums as (select {by}, rep, sum(w) as drawn, {sums} from (select *, {WEIGHT} as w from {tag}_draws where rep < {replicates})
  where w > 0 group by {by}, rep)"""


def win_sql(base: str, cand: str, name: str) -> str:
    d = f"(sqrt({base} / drawn) - sqrt({cand} / drawn))"
    return (f"avg(case when {d} > 0 then 1.0::double else 0.0::double end) as win_{name}, "
            f"quantile_cont({d}, 0.05) as low_{name}, quantile_cont({d}, 0.95) as high_{name}")


SHARE = "case when sum({b} - {c}) > 0 then 100 * max({b} - {c}) / sum({b} - {c}) end"


def _scored(spark, sf, split="composition"):
    return scored_split(departures(spark, sf), split, CAL, TRIGGER, SPECIALISTS, spec=SPEC)


def _rows(spark, sf, split="composition"):
    return scored_rows(departures(spark, sf), split, CAL, SPECIALISTS, spec=SPEC)


COMP = f"{DEPS}, {split_sql('composition')}"


@query("agg14_error_metrics", f"""with {COMP}, e as (select entity, abs(base - duration_s) as a from scored)
select entity, count(*) as n, round(sqrt(avg(a * a)), 6) as rmse, round(avg(a), 6) as mae, round(median(a), 6) as median_abs,
  round(100 * avg(case when a <= 1 then 1.0::double else 0 end), 6) as within_1s, round(100 * avg(case when a <= 30 then 1.0::double else 0 end), 6) as within_30s,
  round(100 * avg(case when a <= 60 then 1.0::double else 0 end), 6) as within_60s from e group by entity""")
def metrics(spark, sf):
    scored = _rows(spark, sf)
    out = error_metrics(scored, "base", "duration_s", ["entity"])
    return rounded(out, "rmse", "mae", "median_abs", "within_1s", "within_30s", "within_60s")


@query("agg15_sliced_rmse", f"""with {COMP}
select case when grouping(entity) = 1 then 'month' else 'entity_month' end as slice, month, entity, count(*) as n,
  round(sqrt(avg(pow(base - duration_s, 2))), 6) as rmse from scored group by grouping sets ((month), (entity, month))""")
def sliced(spark, sf):
    return rounded(sliced_rmse(_rows(spark, sf), "base", "duration_s"), "rmse")


@query("srt2_worst_slices", f"""with {COMP} select month, entity, count(*) as n,
  round(sqrt(avg(pow(base - duration_s, 2))), 6) as rmse from scored group by entity, month order by rmse desc""")
def worst(spark, sf):
    return rounded(worst_slices(_rows(spark, sf), "base", "duration_s"), "rmse")


@query("agg15_tail_report", f"""with {COMP}, e as (select *, pow(base - duration_s, 2) as se from scored)
select count(*) as n, round(sqrt(avg(se)), 6) as rmse, round(avg(abs(base - duration_s)), 6) as mae,
  count(*) filter (duration_s <= 3600) as n_normal, round(sqrt(avg(se) filter (duration_s <= 3600)), 6) as rmse_normal,
  count(*) filter (duration_s > 3600) as n_tail, round(sqrt(avg(se) filter (duration_s > 3600)), 6) as rmse_tail,
  round(100 * sum(se) filter (duration_s > 3600) / sum(se), 6) as pct_error_tail,
  count(*) filter (offblock_missing = 1) as n_flagged, round(sqrt(avg(se) filter (offblock_missing = 1)), 6) as rmse_flagged,
  round(sqrt(avg(se) filter (offblock_missing = 0)), 6) as rmse_unflagged, round(median(abs(base - duration_s)), 6) as median_abs from e""")
def tails(spark, sf):
    out = tail_report(_rows(spark, sf), "base", "duration_s", "offblock_missing")
    return rounded(out, "rmse", "mae", "rmse_normal", "rmse_tail", "pct_error_tail", "rmse_flagged", "rmse_unflagged", "median_abs")


@query("agg16_error_concentration", f"""with {COMP}, e as (select entity, pow(base - duration_s, 2) as se from scored)
select entity, count(*) as n, round(sqrt(sum(se) / count(*)), 6) as rmse, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct_rows,
  round(100 * sum(se) / sum(sum(se)) over (), 6) as pct_error from e group by entity""")
def concentration(spark, sf):
    out = error_concentration(_rows(spark, sf), "base", "duration_s", ["entity"]).drop("se")
    return rounded(out, "rmse", "pct_rows", "pct_error")


@query("agg17_largest_row_share", f"""with {COMP}, e as (select entity, pow(base - duration_s, 2) as eb, pow(cand - duration_s, 2) as ec from scored)
select entity, round({SHARE.format(b='eb', c='ec')}, 6) as largest_share from e group by entity""")
def row_share(spark, sf):
    scored = _rows(spark, sf)
    gain = squared_error("base", "duration_s") - squared_error("cand", "duration_s")
    return scored.groupBy("entity").agg(r6(largest_row_share(gain), "largest_share"))


@query("agg18_entity_lines", f"""with {DEPS} select entity, count(*) as n, round(regr_intercept(duration_s, move_minus_sched), 5) as intercept,
  round(regr_slope(duration_s, move_minus_sched), 6) as slope from deps group by entity""")
def lines(spark, sf):
    out = fit_line(departures(spark, sf), F.col("move_minus_sched").cast("double"), "duration_s", ["entity"])
    return rounded(out, "slope").withColumn("intercept", F.round("intercept", 5))


@query("agg19_paired_bootstrap", f"""with {COMP}, errs as (select id, entity, pow(base - duration_s, 2) as eb, pow(cand - duration_s, 2) as ec from scored),
{boot_sql('errs', 'entity', ['eb', 'ec'], 2000)}, w as (select entity, {win_sql('eb', 'ec', 'raw')} from boot_sums group by entity)
select entity, round(win_raw, 6) as win_raw, round(low_raw, 6) as low_raw, round(high_raw, 6) as high_raw from w""")
def bootstrap(spark, sf):
    scored = _rows(spark, sf)
    arms = scored.withColumn("b", squared_error("base", "duration_s")).withColumn("c", squared_error("cand", "duration_s"))
    return rounded(paired_bootstrap(arms, "id", {"raw": ("b", "c")}, ["entity"], 2000), "win_raw", "low_raw", "high_raw")


@query("ovl1_overlay_line", f"with {DEPS}, {line_sql('composition')} select n, round(a, 5) as intercept, round(b, 6) as slope from line")
def overlay_line(spark, sf):
    pool = split_frames(departures(spark, sf), "composition", CAL)["pool"]
    return rounded(fit_overlay(pool, TRIGGER), "slope").withColumn("intercept", F.round("intercept", 5))


@query("fil5_overlay_trigger", f"with {DEPS} select id, entity, move_minus_sched from deps where {IN_SCOPE}")
def triggered(spark, sf):
    return departures(spark, sf).filter(TRIGGER.hit()).select("id", "entity", "move_minus_sched")


@query("ovl2_apply_overlay", f"with {COMP}, {line_sql('composition')}, {arms_sql(60.0)} select id, touched, round(base_o, 4) as base_overlaid, "
       "round(cand_o, 4) as cand_overlaid from arms")
def overlaid(spark, sf):
    scored, line = _scored(spark, sf)
    out = apply_overlay(scored, TRIGGER, ["base", "cand"], line, floor=60.0)
    return out.select("id", "touched", F.round("base_overlaid", 4).alias("base_overlaid"), F.round("cand_overlaid", 4).alias("cand_overlaid"))


_LIMITS = ", ".join(f"({t})" for t in LIMITS)
SWEEP_SQL = f"""limits(threshold) as (values {_LIMITS}),
scopes(scope, member) as (select 'some', unnest({list(SCOPE)}) union all select 'all', unnest(['S' || i for i in range(10)])),
cfg_lines as (select scope, threshold, count(*) as n, regr_intercept(duration_s, move_minus_sched) as a, regr_slope(duration_s, move_minus_sched) as b
  from deps join scopes on member = entity join limits on move_minus_sched > threshold where {POOLS['composition']} and offblock_missing = 1 group by all),
hits as (select s.scope, l.threshold, t.duration_s as y, t.move_minus_sched as x, t.base, c.n, c.a, c.b
  from scored t join scopes s on s.member = t.entity join limits l on t.move_minus_sched > l.threshold
  left join cfg_lines c on c.scope = s.scope and c.threshold = l.threshold where offblock_missing = 1),
forms as (select scope, threshold, 'identity' as form, y, base, x as p from hits
  union all select scope, threshold, 'calibrated', y, base, a + b * x from hits where n >= 20),
tot as (select count(*) as n, sum(pow(base - duration_s, 2)) as sse from scored),
swept as (select scope, threshold, form, count(*) as replaced,
    sqrt((any_value(tot.sse) - sum(pow(base - y, 2)) + sum(pow(p - y, 2))) / any_value(tot.n)) as rmse, sqrt(any_value(tot.sse) / any_value(tot.n)) as rmse0
  from forms, tot group by scope, threshold, form)"""


def _swept(spark, sf):
    scored = _rows(spark, sf)
    pool = split_frames(departures(spark, sf), "composition", CAL)["pool"]
    return sweep(pool, scored, "base", {"some": SCOPE, "all": None}, LIMITS, WIDE)


@query("ovl3_threshold_sweep", f"with {COMP}, {SWEEP_SQL} select scope, threshold, form, replaced, round(rmse, 5) as rmse, round(rmse - rmse0, 5) as change from swept")
def swept(spark, sf):
    return _swept(spark, sf).withColumn("rmse", F.round("rmse", 5)).withColumn("change", F.round("change", 5))


@query("srt4_best_configuration", f"with {COMP}, {SWEEP_SQL} select scope, threshold, form, replaced from swept order by rmse, scope, threshold, form limit 1")
def best(spark, sf):
    return best_configuration(_swept(spark, sf)).select("scope", "threshold", "form", "replaced")


@query("ovl4_leave_one_month_out", f"""with {DEPS}, limits(threshold) as (values {_LIMITS}),
fb as (select median(duration_s) as f from deps where entity in {SCOPE}),
trig as (select threshold, month, duration_s::double as y, move_minus_sched::double as x from deps join limits on move_minus_sched > threshold
  where entity in {SCOPE} and offblock_missing = 1),
big as (select threshold from trig group by threshold having count(*) >= 24),
fits as (select h.threshold, h.month, regr_intercept(o.y, o.x) as a, regr_slope(o.y, o.x) as b
  from (select distinct threshold, month from trig where threshold in (select threshold from big)) h
  join trig o on o.threshold = h.threshold and o.month <> h.month group by all having count(*) >= 10),
pr as (select t.threshold, t.y, f, unnest(['identity', 'shrunk', 'calibrated']) as form, unnest([x, 0.95::double * x + (1 - 0.95::double) * f, a + b * x]) as p
  from trig t join fits using (threshold, month), fb)
select threshold, form, count(*) as rows, round(sum(pow(f - y, 2) - pow(p - y, 2)), 1) as sse_removed,
  round(100 * (1 - sum(pow(p - y, 2)) / sum(pow(f - y, 2))), 5) as pct_removed, count(*) filter (pow(p - y, 2) > pow(f - y, 2)) as rows_worse
from pr group by threshold, form""")
def lomo(spark, sf):
    out = leave_one_month_out(departures(spark, sf), TRIGGER, thresholds=LIMITS)
    return out.withColumn("sse_removed", F.round("sse_removed", 1)).withColumn("pct_removed", F.round("pct_removed", 5))


MONTHS = range(1, 13)
_STABLE = """count(e) as triggered, max(e) as worst_abs, round(100 * avg(case when e <= 60 then 1.0::double when e > 60 then 0 end), 6) as within_60s, median(e) as median_abs"""
_ERRS = "select entity, month, abs(move_minus_sched - duration_s)::double as e from deps where"


@query("ovl5_stability_by_month", f"""with {DEPS}, t as ({_ERRS} {ANYWHERE.format(t=3600)}), m as (select cast(unnest(range(1, 13)) as int) as month)
select m.month, {_STABLE} from m left join t on t.month = m.month group by m.month""")
def stable_months(spark, sf):
    """All twelve months over every entity; those without a trigger with 0 rows."""
    return rounded(stability(departures(spark, sf), WIDE, "month", MONTHS), "within_60s")


@query("ovl5_stability_by_entity", f"with {DEPS}, t as ({_ERRS} {ANYWHERE.format(t=3600)}) select entity, {_STABLE} from t group by entity having count(*) >= 3")
def stable_entities(spark, sf):
    return rounded(stability(departures(spark, sf), WIDE, "entity", min_rows=3), "within_60s")


@query("ovl5_rare_triggers", f"with {DEPS}, t as ({_ERRS} (entity in {SCOPE} and offblock_missing = 1 and move_minus_sched > 5400)), m as (select cast(unnest(range(1, 13)) as int) as month) "
       f"select m.month, {_STABLE} from m left join t on t.month = m.month group by m.month")
def rare_months(spark, sf):
    """The same with a threshold that few rows pass, so that months without a trigger occur."""
    return rounded(stability(departures(spark, sf), Trigger(SCOPE, threshold=5400), "month", MONTHS), "within_60s")


@query("ovl5_exposure", f"""with {DEPS}, limits(threshold) as (values {_LIMITS})
select threshold, count(*) filter (entity in {SCOPE}) as in_scope, count(*) as anywhere
from deps join limits on move_minus_sched > threshold where offblock_missing = 1 group by threshold""")
def exposed(spark, sf):
    return exposure(departures(spark, sf), TRIGGER, LIMITS)


FLAGS = ("A", "N", "R")
_LINES = """goods as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as entity, month(l_shipdate) <= 9 as held, 1000 * l_quantity::double as base, l_extendedprice::double as price from lineitem),
cl as (select entity, count(*) as n, regr_intercept(price, base) as a, regr_slope(price, base) as b from goods where held group by entity)"""
_CAL = scored_sql("month <= 8", "month in (9, 10)")
_CAL_LINES = ("cl as (select entity, count(*) as n, regr_intercept(duration_s, base) as a, regr_slope(duration_s, base) as b "
              "from scored where month = 9 group by entity)")


def _calibration_rows(spark, sf):
    d = departures(spark, sf)
    out = settle(closed_form_predictions(d.filter("month <= 8"), d.filter("month in (9, 10)"), "entity", SPECIALISTS, SPEC), "scored")
    return out.filter("month = 9"), out.filter("month = 10")


@query("cal1_affine_calibration", f"""with {DEPS}, {_CAL}, {_CAL_LINES}
select id, round(greatest(0.0, a + b * base), 4) as base_calibrated, case when a + b * base < 0 then 1 else 0 end as clipped
from scored s join cl using (entity) where month = 10""")
def calibrated(spark, sf):
    held, test = _calibration_rows(spark, sf)
    return calibrate(test, held, "base", "duration_s", min_rows=20).select(
        "id", F.round("base_calibrated", 4).alias("base_calibrated"), "clipped")


@query("cal1_price_calibration", f"""with {_LINES}
select l_orderkey, l_linenumber, l_partkey, round(greatest(0.0, a + b * base), 4) as base_calibrated, case when a + b * base < 0 then 1 else 0 end as clipped
from goods join cl using (entity) where not held""")
def calibrated_prices(spark, sf):
    """Prices of the last quarter's lines from their quantities, fitted per return flag on the rest, with the library's own 1,000 rows."""
    goods = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("entity"), (F.month("l_shipdate") <= 9).alias("held"),
        (1000 * F.col("l_quantity").cast("double")).alias("base"), F.col("l_extendedprice").cast("double").alias("price"))
    out = calibrate(goods.filter(~F.col("held")), goods.filter("held"), "base", "price", entities=FLAGS)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("base_calibrated", 4).alias("base_calibrated"), "clipped")


@query("cal1_calibration_lines", f"with {DEPS}, {_CAL}, {_CAL_LINES} select entity, n, round(a, 4) as intercept, round(b, 6) as slope from cl")
def calibration(spark, sf):
    held, _ = _calibration_rows(spark, sf)
    out = calibration_lines(held, "base", "duration_s")
    return rounded(out, "slope").withColumn("intercept", F.round("intercept", 4))


NUMBERS = ("base_raw", "cand_raw", "base_overlaid", "cand_overlaid", "max_change_outside", "largest_share",
           "win_raw", "low_raw", "high_raw", "win_overlaid", "low_overlaid", "high_overlaid")


def gate_sql(split: str, policy: str, floor: float | None = None, replicates: int = 2000) -> str:
    outside = f"entity not in {SEGMENTS}"
    confident = "win_raw >= 0.95 and win_overlaid >= 0.95" if policy == "both" else "win_overlaid >= 0.95"
    return f"""with {DEPS}, {split_sql(split)}, {line_sql(split)}, {arms_sql(floor)},
lab as (select *, '{split}' as label from errs), {boot_sql('lab', 'label', ['eb', 'ec', 'ebo', 'eco'], replicates)},
pt as (select label, count(*) as n, count(*) filter (touched) as touched, sqrt(avg(eb)) as base_raw, sqrt(avg(ec)) as cand_raw,
  sqrt(avg(ebo)) as base_overlaid, sqrt(avg(eco)) as cand_overlaid, count(*) filter ({outside}) as rows_outside,
  count(*) filter ({outside} and cand <> base) as changed_outside, coalesce(max(abs(cand - base)) filter ({outside}), 0) as max_change_outside,
  count(*) filter (not coalesce(isfinite(base) and isfinite(cand) and isfinite(ebo) and isfinite(eco), false)) as unusable,
  {SHARE.format(b='ebo', c='eco')} as largest_share from lab group by label),
bt as (select label, {win_sql('eb', 'ec', 'raw')}, {win_sql('ebo', 'eco', 'overlaid')} from boot_sums group by label)
select label, n, touched, rows_outside, changed_outside, unusable, {', '.join(f'round({c}, 6) as {c}' for c in NUMBERS)},
  cand_raw < base_raw as improves_raw, cand_overlaid < base_overlaid as improves_overlaid, win_raw >= 0.95 as confident_raw,
  win_overlaid >= 0.95 as confident_overlaid, changed_outside = 0 as unchanged, coalesce(largest_share <= 50, false) as broad,
  cand_raw < base_raw and cand_overlaid < base_overlaid and {confident} and changed_outside = 0 and coalesce(largest_share <= 50, false) and unusable = 0 as passed
from pt join bt using (label)"""


def _gate(spark, sf, split, policy, floor=None):
    scored, line = _scored(spark, sf, split)
    scope = F.col("entity").isin(*SPECIALISTS)
    return rounded(overlay_gate(scored, TRIGGER, line, scope, split, policy, floor=floor), *NUMBERS)


@query("gat1_composition_gate", gate_sql("composition", "both", 60.0))
def composition_gate(spark, sf):
    return _gate(spark, sf, "composition", "both", 60.0)


@query("gat1_shipping_policy", gate_sql("composition", "shipping", 60.0))
def shipping_gate(spark, sf):
    return _gate(spark, sf, "composition", "shipping", 60.0)


def _confirmation(split: str):
    @query(f"gat2_{split}_confirmation", gate_sql(split, "shipping"))
    def run(spark, sf):
        return _gate(spark, sf, split, "shipping")
    return run


for _split in ("forward", "seasonal", "december", "october"):
    _confirmation(_split)


def plain_sql(label: str, cand: str) -> str:
    return f"""with {COMP}, lab as (select id, '{label}' as label, pow(base - duration_s, 2) as eb, pow({cand} - duration_s, 2) as ec from scored),
{boot_sql('lab', 'label', ['eb', 'ec'], 2000)}, pt as (select label, count(*) as n, sqrt(avg(eb)) as base_raw, sqrt(avg(ec)) as cand_raw,
  count(*) filter (not coalesce(isfinite(eb) and isfinite(ec), false)) as unusable,
  {SHARE.format(b='eb', c='ec')} as largest_share from lab group by label), bt as (select label, {win_sql('eb', 'ec', 'raw')} from boot_sums group by label)
select label, n, unusable, round(base_raw, 6) as base_raw, round(cand_raw, 6) as cand_raw, round(largest_share, 6) as largest_share, round(win_raw, 6) as win_raw,
  round(low_raw, 6) as low_raw, round(high_raw, 6) as high_raw, cand_raw < base_raw as improves_raw, win_raw >= 0.95 as confident_raw,
  cand_raw < base_raw and win_raw >= 0.95 and unusable = 0 as passed from pt join bt using (label)"""


@query("gat3_plain_gate", plain_sql("plain", "cand"))
def plain(spark, sf):
    return rounded(plain_gate(_rows(spark, sf), "plain"), "base_raw", "cand_raw", "largest_share", "win_raw", "low_raw", "high_raw")


@query("gat3_missing_predictions", f"""with {COMP} select 'holes' as label, count(*) as n, count(*) filter (id % 10 = 3) as unusable, false as passed from scored""")
def holes(spark, sf):
    """A candidate that is perfect where it answers and silent elsewhere must not pass."""
    silent = F.when(F.col("id") % 10 != 3, F.col("duration_s").cast("double"))
    return plain_gate(_rows(spark, sf).withColumn("cand", silent), "holes").select("label", "n", "unusable", "passed")


@query("gat4_outside_invariance", f"""with {COMP} select count(*) filter (entity not in {SEGMENTS}) as rows_outside,
  count(*) filter (entity not in {SEGMENTS} and base is distinct from cand) as changed_outside,
  coalesce(max(abs(cand - base)) filter (entity not in {SEGMENTS}), 0)::double as max_change_outside from scored""")
def outside(spark, sf):
    return _rows(spark, sf).agg(*invariance(F.col("entity").isin(*SPECIALISTS)))


@query("gat5_keep_rule", f"""with {COMP}, {line_sql('composition')}, {arms_sql(60.0)}, sub as (select *, 'keep' as label from errs),
{boot_sql('sub', 'label', ['ebo', 'eco'], KEEP_REPLICATES)}, bt as (select label, {win_sql('ebo', 'eco', 'raw')} from boot_sums group by label),
pt as (select label, count(*) as n, sqrt(avg(ebo)) as b, sqrt(avg(eco)) as c from sub group by label)
select label, n, round(b, 6) as base_raw, round(c, 6) as cand_raw, round(win_raw, 6) as win_raw, c < b and win_raw >= 0.95 as passed
from pt join bt using (label)""")
def keep(spark, sf):
    scored, line = _scored(spark, sf)
    arms = apply_overlay(scored, TRIGGER, ["base", "cand"], line, floor=60.0).drop("base", "cand")
    arms = arms.withColumnsRenamed({"base_overlaid": "base", "cand_overlaid": "cand"})
    out = plain_gate(arms, "keep", replicates=KEEP_REPLICATES)
    return rounded(out, "base_raw", "cand_raw", "win_raw").select("label", "n", "base_raw", "cand_raw", "win_raw", "passed")


@query("gat6_persisted_verdict", f"""with {COMP}, e as (select sqrt(avg(pow(base - duration_s, 2))) as c, sqrt(avg(pow(cand - duration_s, 2))) as m from scored)
select c > m as permitted, round(c, 6) as control, round(m, 6) as model from e""")
def persisted(spark, sf):
    """Persist the verdict, read it back, and let the check decide whether a final fit may run."""
    verdict = settle(plain_gate(_rows(spark, sf), "final", replicates=KEEP_REPLICATES), "verdict")
    try:
        require_better(verdict)
        permitted = True
    except ValueError:
        permitted = False
    return verdict.select(F.lit(permitted).alias("permitted"), r6("base_raw", "control"), r6("cand_raw", "model"))


_SLICES = {"target_normal": "duration_s <= 3600", "target_tail": "duration_s > 3600", "flag_set": "offblock_missing = 1",
           "flag_clear": "offblock_missing = 0", "month_01": "month = 1", "month_07": "month = 7"}


@query("gat1_change_by_slice", f"with {COMP}, {line_sql('composition')}, {arms_sql(60.0)} " + " union all ".join(
    f"select '{n}' as slice, count(*) as n, round(sqrt(avg(ebo)), 6) as base_rmse, round(sqrt(avg(eco)), 6) as cand_rmse from errs where {c} having count(*) > 0"
    for n, c in _SLICES.items()))
def slices(spark, sf):
    scored, line = _scored(spark, sf)
    return rounded(slice_table(scored, TRIGGER, line, floor=60.0), "base_rmse", "cand_rmse")


OCT = f"{DEPS}, {split_sql('october')}"
ENC_ARM = "coalesce(0.5::double * base + 0.5::double * enc, base)"


def _october(spark, sf):
    """Both arms, raw and under one overlay; members are chosen on the overlaid ones."""
    scored, line = _scored(spark, sf, "october")
    arms = scored.withColumn("blend", F.coalesce(0.5 * F.col("base") + 0.5 * F.col(SPEC.name), F.col("base")))
    return apply_overlay(arms, TRIGGER, ["base", "blend"], line, required=True)


MEMBERS_SQL = f"""{line_sql('october')}, raw as (select id, entity, duration_s, base, {ENC_ARM} as blend, {IN_SCOPE} as touched, a + b * move_minus_sched as over from scored, line),
errs as (select id, entity, base, blend, pow(case when touched then over else base end - duration_s, 2) as eb, pow(case when touched then over else blend end - duration_s, 2) as ec from raw),
{boot_sql('errs', 'entity', ['eb', 'ec'], 2000)}, bt as (select entity, {win_sql('eb', 'ec', 'rate')} from boot_sums group by entity),
pt as (select entity, count(*) as n, sqrt(avg(eb)) as base_rmse, sqrt(avg(ec)) as cand_rmse, {SHARE.format(b='eb', c='ec')} as largest_share from errs group by entity),
members as (select *, base_rmse - cand_rmse as gain, base_rmse - cand_rmse >= 1.0 and win_rate >= 0.8 and coalesce(largest_share <= 50, false) as selected
  from pt join bt using (entity))"""


@query("sel1_member_selection", f"""with {OCT}, {MEMBERS_SQL} select entity, n, round(base_rmse, 6) as base_rmse, round(cand_rmse, 6) as cand_rmse,
  round(largest_share, 6) as largest_share, round(win_rate, 6) as win_rate, round(gain, 6) as gain, selected from members""")
def members(spark, sf):
    out = select_members(_october(spark, sf), "entity", "base_overlaid", "blend_overlaid", "duration_s")
    return rounded(out, "base_rmse", "cand_rmse", "largest_share", "win_rate", "gain")


@query("sel1_adopted_predictions", f"""with {OCT}, {MEMBERS_SQL} select id, round(case when selected then blend else base end, 6) as pred
from errs join members using (entity)""")
def adopted(spark, sf):
    o = _october(spark, sf)
    m = settle(select_members(o, "entity", "base_overlaid", "blend_overlaid", "duration_s"), "members")
    return adopt_members(o, m, "entity", "base", "blend").select("id", r6("pred"))


_MIX = {"incumbent": 0.0, "leaves_down": 0.5, "leaves_up": 0.9, "min_data_down": 0.25, "min_data_up": 0.75}


def _config_arms(spark, sf):
    scored, line = _scored(spark, sf, "october")
    enc = F.coalesce(F.col(SPEC.name), F.col("base"))
    out = scored.withColumns({n: (1 - w) * F.col("base") + w * enc for n, w in _MIX.items()})
    return settle(apply_overlay(out, TRIGGER, list(_MIX), line, required=True), "configs")


def _configs_sql() -> str:
    cols = ", ".join(f"{1 - w}::double * base + {w}::double * coalesce(enc, base) as {n}" for n, w in _MIX.items())
    over = ", ".join(f"case when {IN_SCOPE} then a + b * move_minus_sched else {n} end as {n}_o" for n in _MIX)
    errs = ", ".join(f"pow({n} - duration_s, 2) as r_{n}, pow({n}_o - duration_s, 2) as o_{n}" for n in _MIX)
    others = [n for n in _MIX if n != "incumbent"]
    wins = ", ".join(win_sql("o_incumbent", f"o_{n}", n) for n in others)
    rows = " union all ".join(
        f"select '{n}' as config, r_{n} as raw, o_{n} as ovl, " + (f"win_{n}" if n != "incumbent" else "null::double") +
        f" as win_rate, s_{n} as largest_share, r_incumbent as r0, o_incumbent as o0 from pt, bt" for n in _MIX)
    pt = ", ".join(f"sqrt(avg(r_{n})) as r_{n}, sqrt(avg(o_{n})) as o_{n}, {SHARE.format(b='o_incumbent', c=f'o_{n}')} as s_{n}" for n in _MIX)
    return f"""with {OCT}, {line_sql('october')}, c1 as (select *, {cols} from scored), c2 as (select *, {over} from c1, line),
c3 as (select id, 1 as one, {errs} from c2), {boot_sql('c3', 'one', ['o_' + n for n in _MIX], 2000)},
bt as (select {wins} from boot_sums), pt as (select {pt} from c3), u as ({rows})
select config, round(raw, 6) as raw_rmse, round(ovl, 6) as overlaid_rmse, round(win_rate, 6) as win_rate, round(largest_share, 6) as largest_share,
  coalesce(raw < r0 and ovl < o0 and win_rate >= 0.9875, false) as eligible from u"""


@query("sel2_capacity_comparison", _configs_sql())
def capacity(spark, sf):
    out = compare_configs(_config_arms(spark, sf), list(_MIX), "duration_s")
    return rounded(out, "raw_rmse", "overlaid_rmse", "win_rate", "largest_share")


def _choice_sql() -> str:
    head = _configs_sql()
    head = head[:head.rindex("select config, round(raw")]
    names = list(_MIX)
    grid = ", ".join(f"('{n}', {c['leaves']}, {c['min_data']})" for n, c in CONFIGS.items())
    return head + f""", elig as (select config, ovl from u where coalesce(raw < r0 and ovl < o0 and win_rate >= 0.9875, false)),
best as (select config from elig order by ovl, config limit 1),
long as (select rep, drawn, unnest({names}) as config, unnest([{', '.join('o_' + n for n in names)}]) as v from boot_sums),
wins as (select l.config, avg(case when sqrt(l.v / l.drawn) - sqrt(b.v / b.drawn) > 0 then 1.0::double else 0 end) as win
  from long l join long b on b.rep = l.rep and b.config in (select config from best) where l.config in (select config from elig) group by l.config),
grid(config, leaves, min_data) as (values {grid})
select config, leaves, min_data from wins join grid using (config) where config in (select config from best) or win < 0.9875
order by leaves, min_data desc, config limit 1"""


@query("sel2_capacity_choice", _choice_sql())
def capacity_choice(spark, sf):
    arms = _config_arms(spark, sf)
    compared = settle(compare_configs(arms, list(_MIX), "duration_s"), "compared")
    return choose_config(arms, compared, "duration_s", CONFIGS)
