"""Backoff medians, folds, splits and target encodings."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventide.catalog.adapter import DEPS, LEDGER, SUMMER, departures, ledger
from eventide.catalog.registry import query, rounded
from eventide.functions.expr import winsorised
from eventide.operators.backoff import (CEILING, FLOOR, LEVELS, MIN_SUPPORT, control_prediction, fit_backoff,
                                        level_columns, predict_backoff)
from eventide.operators.encoding import (CAP, DEFAULT_SPECS, SMOOTHING, Spec, cross_fit, encode_split, fit_map, fit_maps,
                                         parent_prior, transform)
from eventide.plans.settle import settle
from eventide.operators.splits import FOLDS, SPLITS, Calendar, split_roles, with_folds, with_roles

CAL = Calendar(SUMMER)
LEDGER_CAL = Calendar(("BUILDING", "MACHINERY"))
# The ledger has no clock: status stands in for the hour.
TEST_MONTHS = "(month = 1 or (month = 7 and entity in ('S1', 'S2', 'S3')))"


def backoff_sql(fit: str, levels=LEVELS, tag: str = "lv", support: int = MIN_SUPPORT, by: str = "") -> str:
    """CTEs ``<tag>0..`` with the median per level and ``<tag>_top`` with the global one."""
    lead = f"{by}, " if by else ""
    parts = []
    for i, level in enumerate(levels):
        keys = ", ".join(level)
        present = " and ".join(f"{k} is not null" for k in level)
        parts.append(f"{tag}{i} as (select {lead}{keys}, median(duration_s) as m, count(*) as n from {fit} "
                     f"where {present} group by {lead}{keys} having count(*) >= {support})")
    top = f"group by {by}" if by else ""
    parts.append(f"{tag}_top as (select {lead}median(duration_s) as m from {fit} {top})")
    return ", ".join(parts)


def backoff_pick(rows: str, levels=LEVELS, tag: str = "lv", by: str = "") -> tuple[str, str]:
    """(joins, value) for rows aliased ``r``."""
    joins = []
    for i, level in enumerate(levels):
        keys = ([by] if by else []) + list(level)
        joins.append(f"left join {tag}{i} x{i} on " + " and ".join(f"x{i}.{k} = r.{k}" for k in keys))
    top = f"(select m from {tag}_top)"
    if by:
        joins.append(f"left join {tag}_top xt on xt.{by} = r.{by}")
        top = "xt.m"
    return (f"{rows} r " + " ".join(joins),
            f"coalesce({', '.join(f'x{i}.m' for i in range(len(levels)))}, {top})")


KEYS = level_columns(LEVELS)



def lookup_sql(fit: str) -> str:
    rows = []
    for i, level in enumerate(LEVELS):
        cols = ", ".join(f"{k} as k_{k}" if k in level else f"null as k_{k}" for k in KEYS)
        rows.append(f"select {i} as level, {cols}, cast(m as double) as median, n as support from lv{i}")
    blank = ", ".join(f"null as k_{k}" for k in KEYS)
    rows.append(f"select {len(LEVELS)} as level, {blank}, cast(m as double) as median, "
                f"(select count(*) from {fit}) as support from lv_top")
    return " union all ".join(rows)


FIT = "fit as (select * from deps where month not in (1, 7, 12)), test as (select * from deps where " + TEST_MONTHS + ")"


def _parts(spark, sf):
    d = departures(spark, sf)
    roles = split_roles("composition", CAL)
    return d.filter(roles["fit"]), d.filter(roles["test"])


@query("bas1_backoff_lookups", f"with {DEPS}, {FIT}, {backoff_sql('fit')} {lookup_sql('fit')}")
def lookups(spark, sf):
    return fit_backoff(_parts(spark, sf)[0])


@query("jon9_backoff_prediction", f"with {DEPS}, {FIT}, {backoff_sql('fit')} "
       "select r.id, cast({1} as double) as pred from {0}".format(*backoff_pick("test")))
def backoff(spark, sf):
    fit, test = _parts(spark, sf)
    return predict_backoff(test, settle(fit_backoff(fit), "medians")).select("id", "pred")


@query("bas2_control_prediction", f"with {DEPS}, {FIT}, {backoff_sql('fit')} "
       "select r.id, greatest({2}, least({3}, cast({1} as double))) as pred from {0}".format(
           *backoff_pick("test"), FLOOR, CEILING))
def control(spark, sf):
    fit, test = _parts(spark, sf)
    return control_prediction(test, settle(fit_backoff(fit), "medians")).select("id", "pred")


@query("fil6_supported_groups", f"with {DEPS} select entity, lane, count(*) as n from deps group by all having count(*) >= {MIN_SUPPORT}")
def supported(spark, sf):
    return departures(spark, sf).groupBy("entity", "lane").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SUPPORT)


def folds_sql(source: str) -> str:
    rows = []
    for label, train, test in FOLDS:
        for role, months in (("train", train), ("test", test)):
            rows.append(f"select *, '{label}' as fold, '{role}' as role from {source} where month in ({', '.join(map(str, months))})")
    return "folds as (" + " union all ".join(rows) + ")"


def _fold_report(df):
    """RMSE of the global, the entity and the hierarchical median for each fold, in one pass."""
    keys = ["month", *KEYS, "duration_s"]
    counted = settle(df.groupBy(*keys).agg(F.count("*").alias("w")), "counts")
    test = with_folds(counted).filter("role = 'test'")
    shares = {label: f"if(month in ({', '.join(map(str, months))}), w, 0L)" for label, months, _ in FOLDS}
    groups = settle(fit_backoff(counted, folds=("fold", shares), min_support=1), "medians")
    top, entity_level = len(LEVELS), LEVELS.index(("entity",))
    table = groups.filter((F.col("support") >= MIN_SUPPORT) | (F.col("level") == top))
    scored = predict_backoff(test, table, by=["fold"], name="hier")
    entity_only = groups.filter(F.col("level") == entity_level).select(
        "fold", F.col("k_entity").alias("entity"), F.col("median").alias("ent"))
    overall = groups.filter(F.col("level") == top).select("fold", F.col("median").alias("glob"))
    scored = scored.join(entity_only, ["fold", "entity"], "left")
    scored = scored.join(F.broadcast(overall), "fold").withColumn("ent", F.coalesce("ent", "glob"))  # one row per fold of a fixed list
    y = F.col("duration_s")

    def root(p):
        d = F.col(p) - y
        return F.round(F.sqrt(F.sum(F.col("w") * d * d) / F.sum("w")), 6)

    return scored.groupBy("fold").agg(F.sum("w").alias("n"), root("glob").alias("global_rmse"),
                                      root("ent").alias("entity_rmse"), root("hier").alias("hier_rmse"))


def _fold_sql(cte: str, source: str) -> str:
    joins, value = backoff_pick("tests", by="fold")
    return f"""with {cte}, {folds_sql(source)}, trains as (select * from folds where role = 'train'),
tests as (select * from folds where role = 'test'), {backoff_sql('trains', by='fold')},
ent as (select fold, entity, median(duration_s) as m from trains where entity is not null group by fold, entity),
scored as (select r.fold, r.duration_s as y, xt.m as gl, coalesce(e.m, xt.m) as ent, {value} as hier
  from {joins} left join ent e on e.fold = r.fold and e.entity = r.entity)
select fold, count(*) as n, round(sqrt(avg((gl - y) * (gl - y))), 6) as global_rmse,
  round(sqrt(avg((ent - y) * (ent - y))), 6) as entity_rmse, round(sqrt(avg((hier - y) * (hier - y))), 6) as hier_rmse
from scored group by fold"""


@query("bas3_fold_report", _fold_sql(DEPS, "deps"))
def fold_report(spark, sf):
    return _fold_report(departures(spark, sf))


@query("bas3_fold_report_ledger", _fold_sql(LEDGER, "ledger"))
def fold_report_ledger(spark, sf):
    return _fold_report(ledger(spark, sf))


ROLE_SQL = {
    "composition": {"fit": "month not in (1, 7, 12)", "inner": "month = 12", "test": "{comp}"},
    "forward": {"fit": "month <= 5", "inner": "month = 6", "test": "month = 7 and entity in {summer}"},
    "seasonal": {"fit": "day <= 18", "inner": "day between 19 and 20", "test": "{comp} and day >= 22"},
    "december": {"fit": "month <= 10", "inner": "month = 11", "test": "month = 12"},
    "october": {"fit": "month <= 8", "inner": "month = 9", "test": "month = 10"},
}


def roles_sql(source: str, summer: str, cols: str = "id") -> str:
    comp = f"(month = 1 or (month = 7 and entity in {summer}))"
    return " union all ".join(
        f"select {cols}, '{s}' as split, '{r}' as role from {source} where {c.format(comp=comp, summer=summer)}"
        for s, roles in ROLE_SQL.items() for r, c in roles.items())


@query("spl1_split_roles", f"with {DEPS} {roles_sql('deps', str(SUMMER))}")
def roles(spark, sf):
    return with_roles(departures(spark, sf), CAL).select("id", "split", "role")


@query("spl1_split_sizes_ledger", f"with {LEDGER}, r as ({roles_sql('ledger', str(LEDGER_CAL.summer_entities), 'id, duration_s')}) "
       "select split, role, count(*) as n, cast(sum(duration_s) as bigint) as total from r group by split, role")
def role_sizes(spark, sf):
    return with_roles(ledger(spark, sf), LEDGER_CAL).groupBy("split", "role").agg(
        F.count("*").alias("n"), F.sum("duration_s").alias("total"))


@query("fil3_composition_mask", f"with {DEPS} select id, month, entity from deps where {TEST_MONTHS}")
def composition(spark, sf):
    return _parts(spark, sf)[1].select("id", "month", "entity")


@query("fil4_day_range", f"with {DEPS} select id, day from deps where day between 19 and 20")
def day_range(spark, sf):
    return departures(spark, sf).filter(split_roles("seasonal", CAL)["inner"]).select("id", "day")


Y = f"least(cast(duration_s as double), {CAP})"


def map_sql(spec: Spec, source: str, tag: str) -> str:
    """CTEs ``<tag>_prior`` and ``<tag>`` for one encoding fitted on ``source``."""
    keys = ", ".join(spec.keys)
    return f"""{tag}_prior as (select {spec.parent}, (sum({Y}) + {SMOOTHING} * (select avg({Y}) from {source})) / (count(*) + {SMOOTHING}) as prior
  from {source} group by {spec.parent}),
{tag} as (select {', '.join('g.' + k for k in spec.keys)}, (s + {SMOOTHING} * coalesce(prior, (select avg({Y}) from {source}))) / (n + {SMOOTHING}) as v, n
  from (select {keys}, sum({Y}) as s, count(*) as n from {source} group by {keys}) g left join {tag}_prior p on p.{spec.parent} = g.{spec.parent})"""


@query("enc3_parent_prior", f"""with {DEPS}, {FIT} select entity,
  round((sum({Y}) + {SMOOTHING} * (select avg({Y}) from fit)) / (count(*) + {SMOOTHING}), 6) as prior from fit group by entity""")
def prior(spark, sf):
    return rounded(parent_prior(_parts(spark, sf)[0]).drop("grand"), "prior")


def _map_query(spec: Spec):
    keys = ", ".join(spec.keys)
    sql = (f"with {DEPS}, {FIT}, {map_sql(spec, 'fit', 'm')} select {keys}, round(v, 6) as {spec.name}, "
           f"cast(n as int) as {spec.name}_count from m")

    @query(f"enc4_map_{spec.name}", sql)
    def run(spark, sf):
        return rounded(fit_map(_parts(spark, sf)[0], spec), spec.name)
    return run


for _spec in DEFAULT_SPECS:
    _map_query(_spec)

_TE_COLS = ", ".join(f"round(e{i}.v, 6) as {s.name}, cast(e{i}.n as int) as {s.name}_count" for i, s in enumerate(DEFAULT_SPECS))
_TE_NAMES = [c for s in DEFAULT_SPECS for c in s.outputs]


def te_join(rows: str, extra: str = "") -> str:
    return f"{rows} r " + " ".join(
        f"left join m{i} e{i} on " + " and ".join(f"e{i}.{k} = r.{k}" for k in s.keys) + extra.format(i=i)
        for i, s in enumerate(DEFAULT_SPECS))


_MAPS = ", ".join(map_sql(s, "fit", f"m{i}") for i, s in enumerate(DEFAULT_SPECS))


@query("jon11_transform", f"with {DEPS}, {FIT}, {_MAPS} select r.id, {_TE_COLS} from {te_join('test')}")
def transformed(spark, sf):
    fit, test = _parts(spark, sf)
    out = transform(test, fit_maps(fit)).select("id", *_TE_NAMES)
    return rounded(out, *[s.name for s in DEFAULT_SPECS])


def cross_sql(spec: Spec, tag: str, blocks: str = "fit") -> str:
    """Naive leave-one-block-out refit: every block is encoded from the rows of all others."""
    keys = ", ".join(f"f.{k}" for k in spec.keys)
    return f"""{tag}_src as (select b.month as held, f.* from (select distinct month from {blocks}) b join {blocks} f on f.month <> b.month),
{tag}_grand as (select held, avg({Y}) as g from {tag}_src group by held),
{tag}_prior as (select f.held, f.entity, (sum({Y}) + {SMOOTHING} * any_value(g)) / (count(*) + {SMOOTHING}) as prior
  from {tag}_src f join {tag}_grand x on x.held = f.held group by f.held, f.entity),
{tag} as (select f.held, {keys}, (sum({Y}) + {SMOOTHING} * any_value(prior)) / (count(*) + {SMOOTHING}) as v, count(*) as n
  from {tag}_src f join {tag}_prior p on p.held = f.held and p.entity = f.entity group by f.held, {keys})"""


_CROSS = ", ".join(cross_sql(s, f"m{i}") for i, s in enumerate(DEFAULT_SPECS))


@query("enc5_cross_fit", f"with {DEPS}, {FIT}, {_CROSS} select r.id, {_TE_COLS} from {te_join('fit', ' and e{i}.held = r.month')}")
def cross(spark, sf):
    out = cross_fit(_parts(spark, sf)[0], "month").select("id", *_TE_NAMES)
    return rounded(out, *[s.name for s in DEFAULT_SPECS])


_TEST_MAPS = ", ".join(map_sql(s, "fit", f"t{i}") for i, s in enumerate(DEFAULT_SPECS))
_T_COLS = ", ".join(f"round(e{i}.v, 6) as {s.name}, cast(e{i}.n as int) as {s.name}_count" for i, s in enumerate(DEFAULT_SPECS))


@query("enc6_encode_split", f"""with {DEPS}, {FIT}, {_CROSS}, {_TEST_MAPS}
select r.id, 'fit' as role, {_TE_COLS} from {te_join('fit', ' and e{i}.held = r.month')}
union all
select r.id, 'test' as role, {_T_COLS} from {te_join('test').replace('join m', 'join t')}""")
def split_encoded(spark, sf):
    fit, test = _parts(spark, sf)
    enc, (other,) = encode_split(fit, [test], "month")
    cols = ["id", "role", *_TE_NAMES]
    out = enc.withColumn("role", F.lit("fit")).select(cols).unionByName(
        other.withColumn("role", F.lit("test")).select(cols))
    return rounded(out, *[s.name for s in DEFAULT_SPECS])


@query("prj9_winsorised", f"with {DEPS} select entity, cast(max({Y}) as double) as top, count(*) filter (duration_s > {CAP}) as capped, "
       f"round(avg({Y}), 6) as mean from deps group by entity")
def winsor(spark, sf):
    y = winsorised("duration_s", CAP)
    return departures(spark, sf).groupBy("entity").agg(
        F.max(y).alias("top"), F.count_if(F.col("duration_s") > CAP).alias("capped"), F.round(F.avg(y), 6).alias("mean"))
