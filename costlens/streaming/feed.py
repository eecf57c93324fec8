"""Feeding the stream in tests and registered queries.

The log is landed in the landing folder chunk by chunk (whole days per
chunk), and after each chunk the stream processes what arrived
(``availableNow`` on the same checkpoint), as a periodic trigger would.  Each
micro-batch is therefore exactly one chunk, whatever the files' timestamps.
``late_first_chunk`` lands the oldest chunk last, a back-fill arriving behind
the watermark.  Landing only copies rows; all the work is in the stream.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.periods import ntz_literal
from costlens.streaming.rollup import run_once
from costlens.streaming.store import Keys, Store


def day_bounds(logs: DataFrame) -> tuple[date, date] | None:
    """First and last UTC day of the log (one aggregate row)."""
    r = logs.agg(F.min("startTime").alias("lo"), F.max("startTime").alias("hi")).first()
    if r is None or r["lo"] is None:
        return None
    return r["lo"].date(), r["hi"].date()


def chunks(lo: date, hi: date, chunk_days: int) -> list[tuple[date, date]]:
    out, d = [], lo
    while d <= hi:
        out.append((d, min(hi, d + timedelta(days=chunk_days - 1))))
        d += timedelta(days=chunk_days)
    return out


def land(logs: DataFrame, landing: str, lo: date, hi: date, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Copy the days' rows to the landing folder; ``shape`` changes them on the way."""
    st = F.col("startTime")
    part = logs.where((st >= ntz_literal(datetime.combine(lo, time(0))))
                      & (st < ntz_literal(datetime.combine(hi + timedelta(days=1), time(0)))))
    shape(part).write.mode("append").parquet(landing)


def replay(spark: SparkSession, logs: DataFrame, keys: Keys, store: Store, work: str,
           chunk_days: int = 6, lateness: str = "1 day", late_first_chunk: bool = False,
           cfg: ReportConfig = DEFAULT_CONFIG, state_partitions: int | None = None,
           shape: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Land the log chunk by chunk, running the stream after each; returns
    (first day, last day, last progress)."""
    bounds = day_bounds(logs)
    if bounds is None:
        return None, None, None
    parts = chunks(bounds[0], bounds[1], chunk_days)
    if late_first_chunk and len(parts) > 1:
        parts = parts[1:] + parts[:1]
    progress = None
    for lo, hi in parts:
        land(logs, f"{work}/landing", lo, hi, shape)
        progress = run_once(spark, f"{work}/landing", store, f"{work}/checkpoint", keys,
                            lateness, cfg, state_partitions) or progress
    return bounds[0], bounds[1], progress
