"""Dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_month(ts: Column, year: int, month: int) -> Column:
    """Whether a timestamp lies in a month, as a half-open range, which a scan can use."""
    first = dt.datetime(year, month, 1)
    after = dt.datetime(year + month // 12, month % 12 + 1, 1)
    return (ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.lit(after).cast("timestamp_ntz"))


def previous_month(day: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of the month before ``day``."""
    last = day.replace(day=1) - dt.timedelta(days=1)
    return last.replace(day=1), last


def previous_month_bounds(day: Column) -> tuple[Column, Column]:
    before = F.add_months(day, -1)
    return F.trunc(before, "MM").cast("date"), F.last_day(before)


def between_days(ts: Column, first: dt.date, last: dt.date) -> Column:
    """first <= day of ts <= last, as a half-open range."""
    return (ts >= F.lit(dt.datetime.combine(first, dt.time())).cast("timestamp_ntz")) & (ts < F.lit(dt.datetime.combine(last, dt.time()) + dt.timedelta(days=1)).cast("timestamp_ntz"))


def short_day_name(ts: Column) -> Column:
    return F.dayname(ts)
