"""Row-level expressions. All of them keep null as null unless the name says otherwise."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_present(cols: Sequence[str | Column]) -> Column:
    """True where no column is null."""
    out = F.lit(True)
    for c in cols:
        out = out & as_col(c).isNotNull()
    return out


def clip(c: str | Column, lo: float | int | None = None, hi: float | int | None = None) -> Column:
    """Bound a value; null stays null and NaN stays NaN.

    ``least`` and ``greatest`` skip nulls and order NaN last, so neither case may reach them.
    """
    c = as_col(c)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(F.isnan(c.cast("double")), c).when(c.isNotNull(), out)


def missing_flag(c: str | Column) -> Column:
    return as_col(c).isNull().cast("int")


def weekend_flag(isodow: str | Column) -> Column:
    return (as_col(isodow) >= 6).cast("int")


def prefix_group(c: str | Column) -> Column:
    """Everything before the first digit of a code."""
    return F.regexp_replace(as_col(c), "[0-9].*$", "")


def ratio(a: str | Column, b: str | Column) -> Column:
    """Division that gives null for a zero or null denominator."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def winsorised(c: str | Column, cap: float) -> Column:
    return clip(as_col(c).cast("double"), hi=float(cap))


def lenient_double(c: str | Column) -> Column:
    """Unparsable text becomes null instead of an error."""
    return as_col(c).try_cast("double")


def strict_minute(c: str | Column) -> Column:
    """Parse ``yyyy-MM-dd HH:mm``; under ANSI any other text fails the job."""
    return F.to_timestamp_ntz(as_col(c), F.lit("yyyy-MM-dd HH:mm"))


def null_tokens(c: str | Column, tokens: Sequence[str]) -> Column:
    return F.when(~as_col(c).isin(*tokens), as_col(c))


def mapped(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup with a default for unmapped and null keys."""
    c = as_col(c)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    hit = F.when(c.isNotNull(), F.try_element_at(table, c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def banded(c: str | Column, upper: Sequence[tuple[float, str]], rest: str) -> Column:
    """Label of the first upper bound that holds; null and everything above fall to ``rest``."""
    c = as_col(c)
    out = F.when(c <= F.lit(upper[0][0]), F.lit(upper[0][1]))
    for bound, label in upper[1:]:
        out = out.when(c <= F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(rest))


def half_even(c: str | Column, scale: int = 0) -> Column:
    return F.bround(as_col(c), scale)


def finite(c: str | Column) -> Column:
    """Not null, not NaN, not infinite."""
    c = as_col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_to_null(c: str | Column) -> Column:
    """Spark orders NaN above every number, so comparisons need it out of the way."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c), c)


def or_fail(ok: Column, message: str) -> Column:
    """True where ``ok``; the job fails where it is false or unknown. As a filter, a check that rides on the rows it is about."""
    return F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
