"""Fact rows: the common input of every spend report.

A fact row carries ``api_key, day, model`` and five additive measures
(``spend`` as an exact decimal, ``requests``, ``tokens``, ``prompt_tokens``,
``completion_tokens``).  Raw log rows are facts with ``requests = 1``; a daily
rollup at (day, api_key, raw model) grain holds pre-summed facts.  Reports
only ever ``sum`` measures, so they give the same answer from either source,
and a whole-day range can be served from the much smaller rollup.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.functions.money import exact_money, zero_if_null
from costlens.functions.time import utc_day
from costlens.periods import TimeRange, day_range

GRAIN = ("api_key", "day", "model")
ROLLUP_SCHEMA = ("day date, api_key string, model string, spend decimal(38,18), "
                 "requests bigint, tokens bigint, prompt_tokens bigint, completion_tokens bigint")
MEASURE_COLS = ("spend", "requests", "tokens", "prompt_tokens", "completion_tokens")


def log_facts(logs: DataFrame, rng: TimeRange, cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """F2 (closed range on startTime, pushed to the scan) + per-row measures.

    On the day-partitioned layout (a ``day`` column is present) the matching
    day range is added as well, so only those partition folders are listed.
    """
    if "day" in logs.columns:
        logs = logs.where(F.col("day").between(F.lit(rng.first_day), F.lit(rng.last_day)))
    return logs.where(rng.contains(F.col("startTime"))).select(
        "api_key",
        utc_day(F.col("startTime")).alias("day"),
        "model",
        exact_money(F.col("spend"), cfg).alias("spend"),
        # count(request_id): the key column is NOT NULL by contract
        F.when(F.col("request_id").isNotNull(), F.lit(1)).otherwise(F.lit(0))
         .cast("bigint").alias("requests"),
        F.col("total_tokens").cast("bigint").alias("tokens"),
        F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.col("completion_tokens").cast("bigint").alias("completion_tokens"),
    )


def is_whole_days(rng: TimeRange) -> bool:
    return rng.start.time() == time(0, 0) and rng.end.time() == time(23, 59, 59, 999999)


@dataclass(frozen=True)
class Rollup:
    """Rows at (day, api_key, raw model) grain, and the days they cover in full."""

    rows: DataFrame
    first_day: date
    last_day: date


def rollup_facts(rollup: Rollup, rng: TimeRange) -> DataFrame:
    """Facts of the range's days that the rollup covers; the range must be whole days."""
    if not is_whole_days(rng):
        raise ValueError("a daily rollup can only answer whole-day ranges")
    first, last = max(rng.first_day, rollup.first_day), min(rng.last_day, rollup.last_day)
    return rollup.rows.where(F.col("day").between(F.lit(first), F.lit(last))).select(*GRAIN, *MEASURE_COLS)


def facts(logs: DataFrame, rng: TimeRange, cfg: ReportConfig = DEFAULT_CONFIG,
          rollup: Rollup | None = None) -> DataFrame:
    """Facts for ``rng``: covered whole days from the rollup, the rest from the raw log."""
    if rollup is None or not is_whole_days(rng) or rng.last_day < rollup.first_day or rng.first_day > rollup.last_day:
        return log_facts(logs, rng, cfg)
    out = rollup_facts(rollup, rng)
    one = timedelta(days=1)
    if rng.first_day < rollup.first_day:
        out = out.unionByName(log_facts(logs, day_range(rng.first_day, rollup.first_day - one), cfg))
    if rng.last_day > rollup.last_day:
        out = out.unionByName(log_facts(logs, day_range(rollup.last_day + one, rng.last_day), cfg))
    return out


def sum_measures(*names: str) -> list[Column]:
    """Sums of the additive measures (partial + final hash aggregate)."""
    names = names or MEASURE_COLS
    return [F.sum(n).alias(n) for n in names]


def daily_rollup(logs: DataFrame, rng: TimeRange, cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """(day, api_key, raw model) rollup; NULL and empty models are kept."""
    return log_facts(logs, rng, cfg).groupBy(*GRAIN).agg(*sum_measures())


def money_out(df: DataFrame, *names: str) -> DataFrame:
    """Exact decimal money -> double, once, at the end of a report; no amount is 0."""
    for n in names or ("spend",):
        df = df.withColumn(n, zero_if_null(F.col(n)))
    return df
