"""Calendar helpers on naive-UTC timestamps (X6, X7) and stream event time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS_PER_DAY = 86_400_000_000


def utc_day(ts: Column) -> Column:
    """Calendar day of a timestamp_ntz (no time-zone shift)."""
    return F.to_date(ts)


def day_start(day: Column) -> Column:
    """A day as the timestamp of its midnight."""
    return day.cast("timestamp_ntz")


def ntz_epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a naive-UTC timestamp, session-zone free."""
    return (F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(_MICROS_PER_DAY)
            + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
            + F.minute(ts).cast("bigint") * F.lit(60_000_000)
            + (F.date_part(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint"))


def event_instant(ts: Column) -> Column:
    """timestamp_ntz (naive UTC) -> timestamp instant with the same UTC wall clock.

    Watermarks need a ``timestamp`` column; a plain cast would shift by the
    session time zone, this does not.
    """
    return F.timestamp_micros(ntz_epoch_micros(ts))


def instant_utc_day(instant: Column) -> Column:
    """UTC calendar day of a ``timestamp`` instant, session-zone free."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / F.lit(_MICROS_PER_DAY)).cast("int"))
