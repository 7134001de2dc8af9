"""Ranges, periods and zones.  Each kind of range has its own builder; none uses BETWEEN."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_MONTHS = {"1m": 1, "3m": 3, "6m": 6, "12m": 12, "1y": 12}
EPOCH_DAY = dt.date(2020, 1, 1)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def parse_day(text: str) -> dt.date:
    """A date of the form yyyy-MM-dd, or ValueError."""
    if not _DATE.fullmatch(text or ""):
        raise ValueError(f"not a date of the form yyyy-MM-dd: {text!r}")
    return dt.date.fromisoformat(text)


def check_range(first: dt.date, last: dt.date) -> None:
    if first > last:
        raise ValueError(f"{first} is after {last}")


def half_open(ts: Column, start: object = None, end: object = None) -> Column:
    """start <= ts < end; a side that is None is open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ts >= F.lit(start))
    if end is not None:
        cond = cond & (ts < F.lit(end))
    return cond


def since_until(ts: Column, since: object, until: object = None) -> Column:
    """since < ts <= until."""
    return (ts > F.lit(since)) & (F.lit(True) if until is None else ts <= F.lit(until))


def whole_days(ts: Column, first: dt.date, last: dt.date) -> Column:
    """From the first day's 00:00:00 to the last day's 23:59:59, both included."""
    return (ts >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz")) & (ts <= F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))


def local_midnight(day: Column, zone: str = "Asia/Seoul") -> Column:
    """UTC instant of a local midnight."""
    return F.to_utc_timestamp(F.to_timestamp(day), zone)


def end_of_local_day(day: Column, zone: str = "Asia/Seoul") -> Column:
    """UTC instant of the next local midnight, an exclusive end."""
    return local_midnight(F.date_add(F.to_date(day), 1), zone)


def resolve_period(period: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of a preset in calendar months; ``all`` starts at a fixed day."""
    if period == "all":
        return EPOCH_DAY, as_of
    months = PERIOD_MONTHS[period]
    year, month = divmod(as_of.year * 12 + as_of.month - 1 - months, 12)
    last = (dt.date(year + (month + 1) // 12, (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(as_of.day, last)), as_of


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def whole_days_between(a: Column, b: Column) -> Column:
    """Whole spans of 24 hours from a to b."""
    return F.timestamp_diff("DAY", a, b)


def day_chunk(ts: Column) -> Column:
    """Day of the chunk (midnight, next midnight] that holds ts: an instant at midnight belongs to the day before."""
    return F.to_date(F.date_trunc("day", ts - F.expr("INTERVAL 1 MICROSECOND")))


def rent_class(start: Column, end: Column, short: int = 15, month: int = 30) -> Column:
    days = whole_days_between(start, end)
    return F.when(days < short, "SHORT").when(days < month, "MONTH").when(days.isNotNull(), "SUBSCRIPTION")


def korean_day(day: Column) -> Column:
    """A day as a report says it."""
    return F.date_format(day, "yyyy'년' MM'월' dd'일'")
