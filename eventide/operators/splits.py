"""Time-aware splits and folds."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (label, training months, test months).
FOLDS = (
    ("train 01-05, test 06", (1, 2, 3, 4, 5), (6,)),
    ("train 01-06, test 07", (1, 2, 3, 4, 5, 6), (7,)),
    ("train 01-10, test 11", tuple(range(1, 11)), (11,)),
    ("train 01-11, test 12", tuple(range(1, 12)), (12,)),
    ("train 02-12, test 01", tuple(range(2, 13)), (1,)),
)
SPLITS = ("composition", "forward", "seasonal", "december", "october")


@dataclass(frozen=True)
class Calendar:
    """Where a row finds its month (1-12), day of month and entity."""

    summer_entities: tuple[str, ...]
    month: str = "month"
    day: str = "day"
    entity: str = "entity"


def composition_mask(cal: Calendar) -> Column:
    """Month 1 everywhere, and month 7 at the named entities."""
    m = F.col(cal.month)
    return (m == 1) | ((m == 7) & F.col(cal.entity).isin(*cal.summer_entities))


def split_roles(split: str, cal: Calendar) -> dict[str, Column]:
    """Predicates of the fit, inner and test rows of one split."""
    m, d = F.col(cal.month), F.col(cal.day)
    summer = (m == 7) & F.col(cal.entity).isin(*cal.summer_entities)
    if split == "composition":
        return {"fit": ~m.isin(1, 7, 12), "inner": m == 12, "test": composition_mask(cal)}
    if split == "forward":
        return {"fit": m <= 5, "inner": m == 6, "test": summer}
    if split == "seasonal":
        return {"fit": d <= 18, "inner": d.between(19, 20), "test": composition_mask(cal) & (d >= 22)}
    if split == "december":
        return {"fit": m <= 10, "inner": m == 11, "test": m == 12}
    if split == "october":
        return {"fit": m <= 8, "inner": m == 9, "test": m == 10}
    raise ValueError(f"unknown split {split!r}")


def overlay_fit_mask(split: str, cal: Calendar) -> Column:
    """Rows a split may calibrate an overlay on: everything outside its test period."""
    m, d = F.col(cal.month), F.col(cal.day)
    if split == "composition":
        return ~m.isin(1, 7)
    if split == "seasonal":
        return d <= 20
    return split_roles(split, cal)["fit"]


def with_roles(df: DataFrame, cal: Calendar, splits: Sequence[str] = SPLITS) -> DataFrame:
    """(split, role) pairs for every row; a row takes part in several splits."""
    pairs = []
    for s in splits:
        for role, mask in split_roles(s, cal).items():
            pairs.append(F.when(mask, F.struct(F.lit(s).alias("split"), F.lit(role).alias("role"))))
    return (
        df.withColumn("_p", F.explode(F.array(*pairs))).filter(F.col("_p").isNotNull())
        .select(*df.columns, "_p.split", "_p.role")
    )


def with_folds(df: DataFrame, month: str = "month", folds=FOLDS) -> DataFrame:
    """(fold, role) pairs for every row."""
    pairs = []
    for label, train, test in folds:
        for role, months in (("train", train), ("test", test)):
            pairs.append(F.when(F.col(month).isin(*months),
                                F.struct(F.lit(label).alias("fold"), F.lit(role).alias("role"))))
    return (
        df.withColumn("_p", F.explode(F.array(*pairs))).filter(F.col("_p").isNotNull())
        .select(*df.columns, "_p.fold", "_p.role")
    )
