"""Period -> closed time range, computed on the driver as timestamp_ntz literals.

Bounds follow the reference service with the clock as an explicit ``as_of``
(naive UTC); never ``current_timestamp()``:

* today: 00:00:00 .. 23:59:59.999999 of ``as_of``'s day
* week:  Monday 00:00:00 of ``as_of``'s week .. end of **today** (not Sunday)
* month: day 1 00:00:00 .. 23:59:59.999999 of the month's last day

The ad-hoc SQL month window ends at 23:59:59 flat (no fraction); see
``month_sql_window``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Period(str, Enum):
    TODAY = "today"
    WEEK = "week"
    MONTH = "month"


def parse_period(value) -> Period:
    """V2: a period must be one of today/week/month; anything else is an error."""
    if isinstance(value, Period):
        return value
    try:
        return Period(str(value))
    except ValueError:
        raise ValueError(
            f"invalid period {value!r}: expected one of "
            + ", ".join(p.value for p in Period)
        ) from None


def valid_period(value: Column) -> Column:
    """V2 for a column of requested periods; a missing one is not valid."""
    return F.coalesce(value.isin(*[p.value for p in Period]), F.lit(False))


@dataclass(frozen=True)
class TimeRange:
    """Closed range [start, end] on startTime (both ends inclusive)."""

    start: datetime
    end: datetime

    def start_col(self) -> Column:
        return ntz_literal(self.start)

    def end_col(self) -> Column:
        return ntz_literal(self.end)

    def contains(self, col: Column) -> Column:
        # Plain >= / <= comparisons against literals are pushed to the Parquet scan.
        return (col >= self.start_col()) & (col <= self.end_col())

    @property
    def first_day(self) -> date:
        return self.start.date()

    @property
    def last_day(self) -> date:
        return self.end.date()

    def sql_bounds(self) -> tuple[str, str]:
        return (fmt_ts(self.start), fmt_ts(self.end))


def fmt_ts(ts: datetime) -> str:
    return ts.strftime("%Y-%m-%d %H:%M:%S.%f")


def ntz_literal(ts: datetime) -> Column:
    # String -> timestamp_ntz is time-zone independent.
    return F.lit(fmt_ts(ts)).cast("timestamp_ntz")


def _day_start(ts: datetime) -> datetime:
    return ts.replace(hour=0, minute=0, second=0, microsecond=0)


def _day_end(ts: datetime) -> datetime:
    return ts.replace(hour=23, minute=59, second=59, microsecond=999999)


def next_month_start(day):
    """First of the following month, for a date or datetime."""
    if day.month == 12:
        return day.replace(year=day.year + 1, month=1, day=1)
    return day.replace(month=day.month + 1, day=1)


def day_range(first: date, last: date) -> TimeRange:
    """The closed range of whole days."""
    return TimeRange(datetime.combine(first, time(0)), _day_end(datetime.combine(last, time(0))))


def period_range(period, as_of: datetime) -> TimeRange:
    """Period to closed range for the clock ``as_of``."""
    p = parse_period(period)
    if p is Period.TODAY:
        return TimeRange(_day_start(as_of), _day_end(as_of))
    if p is Period.WEEK:
        monday = as_of - timedelta(days=as_of.weekday())
        return TimeRange(_day_start(monday), _day_end(as_of))
    first = _day_start(as_of.replace(day=1))
    last_day = next_month_start(first) - timedelta(days=1)
    return TimeRange(first, _day_end(last_day))


def month_sql_window(as_of: datetime) -> TimeRange:
    """Month start .. month start + 1 month - 1 second (ends at :59 flat)."""
    first = _day_start(as_of.replace(day=1))
    return TimeRange(first, next_month_start(first) - timedelta(seconds=1))


def admin_range(as_of: datetime, start: datetime | None = None,
                end: datetime | None = None) -> TimeRange:
    """Default is the current month; each bound may be overridden on its own.

    A start after the end is not an error: the range is simply empty.
    """
    default = period_range(Period.MONTH, as_of)
    return TimeRange(start or default.start, end or default.end)
