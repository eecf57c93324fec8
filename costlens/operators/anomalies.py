"""Unusual daily spend: each day against the days before it.

Spend per group and UTC day comes from the facts; days without a row count as
zero, from the group's first day in the range on.  A day is judged by the
``window`` days before it: expected is their median, the spread their median
absolute deviation times 1.4826 (which makes it a standard deviation for normal
data), but at least ``share`` of the expected value and ``least`` units of money,
so that a flat history does not raise alarms over cents.  Both are medians, so
an earlier spike does not hide the next one.  Groups are judged once they have a
whole window of days.

A group's days are one array of at most the range's length: one shuffle of daily
sums, no window over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.operators.facts import Rollup, facts
from costlens.periods import Period, period_range
from costlens.sources.tables import Tables

WINDOW, LIMIT = 7, 4.0
SHARE, LEAST = 0.1, 1.0
#: Standard deviations of a normal distribution in its median absolute deviation.
TO_SIGMA = 1.4826


def _middle(values: Column, n: int) -> Column:
    """Median of an array of ``n`` numbers, ``n`` odd."""
    return F.get(F.array_sort(values), F.lit(n // 2))


def _judged(days: Column, spends: Column, window: int) -> Column:
    """One struct per day that has a whole window before it."""
    def judge(i: Column) -> Column:
        history = F.slice(spends, i - window + 1, F.lit(window))
        return F.get(F.transform(F.array(_middle(history, window)), lambda mid: F.struct(
            F.get(days, i).alias("day"), F.get(spends, i).alias("spend"), mid.alias("expected"),
            _middle(F.transform(history, lambda x: F.abs(x - mid)), window).alias("mad"))), F.lit(0))

    n = F.size(days)
    return F.when(n > window, F.transform(F.sequence(F.lit(window), n - 1), judge))


def anomalies(tables: Tables, as_of: datetime, period=Period.MONTH, by: Sequence[str] = ("api_key",), window: int = WINDOW,
              limit: float = LIMIT, share: float = SHARE, least: float = LEAST, cfg: ReportConfig = DEFAULT_CONFIG,
              rollup: Rollup | None = None) -> DataFrame:
    """Days of the period whose spend is ``limit`` spreads or more from expected, per ``by``.

    ``by`` names fact columns (``api_key``, ``model``) or is empty for all spend
    together.  ``window`` is odd.  A null group is a group.
    """
    if window < 1 or window % 2 == 0:
        raise ValueError("window must be odd")
    rng = period_range(period, as_of)
    daily = facts(tables.logs, rng, cfg, rollup).groupBy(*by, "day").agg(F.sum("spend").cast("double").alias("spend"))
    per_day = F.map_from_entries(F.collect_list(F.struct("day", F.coalesce("spend", F.lit(0.0)))))
    series = daily.groupBy(*by).agg(per_day.alias("spends"), F.sequence(F.min("day"), F.lit(rng.last_day)).alias("days"))
    filled = F.transform("days", lambda d: F.coalesce(F.try_element_at("spends", d), F.lit(0.0)))
    one = (series.where(F.col("days").isNotNull()).withColumn("spends", filled)
           .select(*by, F.explode(_judged(F.col("days"), F.col("spends"), window)).alias("x")).select(*by, "x.*"))
    spread = F.greatest(F.lit(TO_SIGMA) * F.col("mad"), F.lit(share) * F.col("expected"), F.lit(least))
    judged = one.withColumn("spread", spread).withColumn("deviation", (F.col("spend") - F.col("expected")) / F.col("spread"))
    return (judged.where(F.abs("deviation") >= limit)
            .select(*by, "day", "spend", "expected", "spread", "deviation",
                    F.when(F.col("deviation") > 0, F.lit("spike")).otherwise(F.lit("drop")).alias("direction")))
