"""Hierarchical-median backoff: the most specific group with enough rows answers."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.expr import clip
from eventide.functions.quantiles import LINEAR, quantiles_of_counts
from eventide.plans.settle import settle

# Most specific first, the support a group needs, and the output range.
LEVELS = (
    ("entity", "stand", "lane", "hour"),
    ("entity", "stand", "lane"),
    ("entity", "lane", "hour", "weekday"),
    ("entity", "lane", "hour"),
    ("entity", "lane"),
    ("entity", "hour"),
    ("entity",),
)
MIN_SUPPORT = 30
FLOOR, CEILING = 60.0, 7200.0


def level_columns(levels: Sequence[Sequence[str]]) -> list[str]:
    return sorted({k for level in levels for k in level})


def _at_levels(df: DataFrame, levels: Sequence[Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """One row per level with the keys outside the level blanked; a null key drops its level."""
    cols = level_columns(levels)
    types = dict(df.select(*cols).dtypes)

    def variant(i: int, level: Sequence[str]) -> str:
        keys = [f"{c if c in level else f'cast(null as {types[c]})'} as k_{c}" for c in cols]
        row = f"struct({', '.join([f'{i} as level', *keys])})"
        known = " and ".join(f"{c} is not null" for c in level)
        return f"if({known}, {row}, null)" if level else row

    variants = ", ".join(variant(i, level) for i, level in enumerate(levels))
    return df.selectExpr(*keep, f"inline(array_compact(array({variants})))")


def fit_backoff(train: DataFrame, levels: Sequence[Sequence[str]] = LEVELS, target: str = "duration_s",
                by: Sequence[str] = (), min_support: int = MIN_SUPPORT, weight: str | None = None,
                folds: tuple[str, Mapping[str, str]] | None = None) -> DataFrame:
    """(by, level, keys, median, support) for every group, plus the global median as last level.

    One aggregation over grouping sets counts the equal targets of a group at every level, so coarse levels shuffle next to nothing. The
    medians of all levels are located together, by ranks in ever narrower cells, so no group's distinct targets have to fit into a task.
    ``weight`` names a count column when ``train`` is collapsed already. ``folds``, a column's name and ``label -> count column``, fits
    one table per label, told apart by that column: a row that counts in several folds is counted once, not copied into each.
    """
    cols = level_columns(levels)
    name, counts = folds or (None, {None: weight or "1L"})
    tallies = [f"_n{i}" for i in range(len(counts))]
    rows = train.filter(F.col(target).isNotNull()).selectExpr(
        *by, *cols, f"{target} as _y", *[f"{c} as {t}" for c, t in zip(counts.values(), tallies, strict=True)])
    sets = {frozenset(level): i for i, level in reversed(list(enumerate([*levels, ()])))}
    cells = rows.groupingSets([[*by, *sorted(level), "_y"] for level in sets], *by, *cols, "_y").agg(
        F.grouping_id().alias("_gid"), *[F.sum(t).cast("long").alias(t) for t in tallies])
    # grouping_id has a bit for each absent column; a null key drops its level
    absent = {i: sum(1 << k for k, c in enumerate(reversed([*by, *cols, "_y"])) if c in cols and c not in level) for level, i in sets.items()}
    known = " or ".join(f"(_gid = {absent[i]}{''.join(f' and {c} is not null' for c in sorted(level))})" for level, i in sets.items())
    which = "case _gid " + " ".join(f"when {gid} then {i}" for i, gid in absent.items()) + " end"
    hist = settle(cells.filter(known).selectExpr(*by, f"{which} as level", *[f"{c} as k_{c}" for c in cols], "_y as _v", *tallies), "histogram")
    group = [*by, *([name] if name else []), "level", *[f"k_{c}" for c in cols]]
    if name:
        labels = ", ".join(f"'{label}', {t}" for label, t in zip(counts, tallies, strict=True))
        hist = hist.selectExpr(*hist.columns, f"stack({len(counts)}, {labels}) as ({name}, _n)")
    else:
        hist = hist.withColumnRenamed("_n0", "_n")
    hist = hist.filter("_n > 0").select(F.struct(*group).alias("_g"), "_v", "_n")
    found = quantiles_of_counts(hist, group, {"median": (0.5, LINEAR)}, "support")
    return found.filter((F.col("support") >= min_support) | (F.col("level") == len(levels)))


def predict_backoff(df: DataFrame, table: DataFrame, levels: Sequence[Sequence[str]] = LEVELS,
                    by: Sequence[str] = (), name: str = "pred") -> DataFrame:
    """Add the median of the first level that knows the row's keys, else the global median.

    Levels are resolved on distinct key combinations; the rows themselves are joined once,
    whatever the number of levels.
    """
    cols = level_columns(levels)
    keys = [*by, *cols]
    combos = df.select(*keys).distinct()
    asked = _at_levels(combos, levels, keys)
    medians = table.filter(F.col("level") < len(levels))
    on = [asked["level"] == medians["level"]]
    on += [asked[b].eqNullSafe(medians[b]) for b in by]
    on += [asked[f"k_{c}"].eqNullSafe(medians[f"k_{c}"]) for c in cols]
    known = asked.join(medians, on).groupBy(*[asked[k] for k in keys]).agg(
        F.min_by(medians["median"], asked["level"]).alias("_m"))
    known = known.select(*[F.col(k).alias(f"_q_{k}") for k in keys], "_m")
    out = df.join(known, [df[k].eqNullSafe(known[f"_q_{k}"]) for k in keys], "left")
    top = table.filter(F.col("level") == len(levels))
    if by:
        top = top.select(*[F.col(b).alias(f"_t_{b}") for b in by], F.col("median").alias("_top"))
        out = out.join(top, [out[b] == top[f"_t_{b}"] for b in by], "left")
        last = F.col("_top")
    else:
        last = top.select("median").scalar()
    return out.select(*df.columns, F.coalesce(F.col("_m"), last).alias(name))


def control_prediction(df: DataFrame, table: DataFrame, levels: Sequence[Sequence[str]] = LEVELS,
                       name: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """The backoff prediction held inside the plausible range."""
    return predict_backoff(df, table, levels, by, name).withColumn(name, clip(name, FLOOR, CEILING))
