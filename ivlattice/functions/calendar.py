"""Calendar columns: the daily snapshot instant, expiry Fridays, month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ivlattice.functions.numeric import col

# The snapshot is taken at 08:05:00 UTC; options expire at 08:00 UTC.
SNAP_MINUTE = 8 * 60 + 5
EXPIRY_MINUTE = 8 * 60


def snap_ts(day: str | Column) -> Column:
    """The snapshot instant of a date, independent of the session's zone."""
    return F.timestamp_micros((F.unix_date(col(day)).cast("long") * 1440 + SNAP_MINUTE) * 60_000_000)


def feature_day(available: str | Column) -> Column:
    """The first day whose snapshot is at or after an instant (right-closed daily bucket)."""
    us = F.unix_micros(col(available)) + (1440 - SNAP_MINUTE) * 60_000_000 - 1
    return F.date_from_unix_date(((us - F.pmod(us, F.lit(86_400_000_000))) / F.lit(86_400_000_000)).cast("int"))


def last_friday(day: str | Column) -> Column:
    return F.next_day(F.date_sub(F.last_day(col(day)), 7), "FRI")


def _days_to(snap: Column, expiry_day: Column) -> Column:
    expiry = (F.unix_date(expiry_day).cast("long") * 1440 + EXPIRY_MINUTE) * 60_000_000
    return F.ceil((expiry - F.unix_micros(snap)) / F.lit(86_400_000_000)).cast("long")


def days_to_monthly(day: str | Column) -> Column:
    """Whole days (rounded up) from the snapshot to the next last-Friday expiry strictly after it."""
    d = col(day)
    this, following = last_friday(d), last_friday(F.add_months(F.trunc(d, "month"), 1))
    s = snap_ts(d)
    n = _days_to(s, this)
    late = (F.unix_date(this).cast("long") * 1440 + EXPIRY_MINUTE) * 60_000_000 <= F.unix_micros(s)
    return F.when(late, _days_to(s, following)).otherwise(n)


def days_to_quarterly(day: str | Column) -> Column:
    d = col(day)
    s = snap_ts(d)
    month = F.trunc(d, "month")
    quarter_end = lambda k: F.add_months(month, F.pmod(-F.month(d), F.lit(3)) + 3 * k)
    this, following = last_friday(quarter_end(0)), last_friday(quarter_end(1))
    late = (F.unix_date(this).cast("long") * 1440 + EXPIRY_MINUTE) * 60_000_000 <= F.unix_micros(s)
    return F.when(late, _days_to(s, following)).otherwise(_days_to(s, this))


def calendar_features(day: str | Column) -> list[Column]:
    d = col(day)
    return [
        F.weekday(d).cast("long").alias("day_of_week"),
        days_to_monthly(d).alias("days_to_monthly_expiry"),
        days_to_quarterly(d).alias("days_to_quarterly_expiry"),
    ]
