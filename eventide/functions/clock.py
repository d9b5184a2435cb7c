"""Timestamps as long microseconds, the order key of every neighbourhood operator."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.functions.expr import MICROS, as_col

MINUTE_US = 60 * MICROS
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def micros(c: str | Column) -> Column:
    """Naive or zoned timestamp to micros since the epoch (session zone is UTC)."""
    return F.unix_micros(as_col(c).cast("timestamp"))


def whole(c: str | Column, step: int) -> Column:
    """Integer division truncating toward zero."""
    return F.call_function("div", as_col(c), F.lit(step))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole seconds from ``earlier`` to ``later`` (micros), truncated toward zero."""
    return whole(as_col(later) - as_col(earlier), MICROS)


def stamp(us: str | Column) -> Column:
    return F.timestamp_micros(as_col(us))


def hour_of(us: str | Column) -> Column:
    return F.hour(stamp(us))


def isodow_of(us: str | Column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(stamp(us)) + 1


def minute_of_day(us: str | Column) -> Column:
    t = stamp(us)
    return F.hour(t) * 60 + F.minute(t)


def calendar(us: str | Column) -> dict[str, Column]:
    t = stamp(us)
    return {
        "hour": F.hour(t),
        "minute_of_day": minute_of_day(us),
        "weekday": isodow_of(us),
        "month": F.month(t),
        "day_of_year": F.dayofyear(t),
        "day": F.dayofmonth(t),
    }
