"""T5: batch reconcile of the rollup from the raw log.

The stream drops rows that arrive behind the watermark.  Reconciling recomputes
whole days from the log and makes them the content of these days, which also
refreshes the alerts of their months and clears days whose rows are gone.

Copies of a request id may lie on two days.  One rule decides which counts: the
copy with the earliest ``startTime`` (equal times: the smallest row).  Copies
arrive within the lateness of the stream, so days are recomputed from a range
that is wider by ``lateness`` on both sides and then cut; days give the same
rows whether they are recomputed together or one by one.

``reconcile_days`` recomputes a given day range; ``reconcile_mismatched``
compares log and rollup group by group, in every measure, over a look-back
range and rewrites only the days that differ.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.operators.facts import GRAIN, MEASURE_COLS, log_facts, sum_measures
from costlens.periods import day_range
from costlens.sources.load import first_copies
from costlens.streaming.store import Store, mark_complete, publish_days

LATENESS = timedelta(days=1)
COUNTED = ("request_id", "startTime", "api_key", "model", "spend", "total_tokens", "prompt_tokens",
           "completion_tokens")


def recompute(logs: DataFrame, lo: date, hi: date, cfg: ReportConfig = DEFAULT_CONFIG,
              lateness: timedelta = LATENESS) -> DataFrame:
    """Rollup rows of days [lo, hi] from the raw log, first copy of each request_id.

    On the day layout the partition filter comes before the de-duplication, so
    only the folders of the widened range are read.
    """
    wide = day_range(lo - lateness, hi + lateness)
    if "day" in logs.columns:
        logs = logs.where(F.col("day").between(F.lit(wide.first_day), F.lit(wide.last_day)))
    read = logs.where(wide.contains(F.col("startTime"))).select(*COUNTED)
    return log_facts(first_copies(read), day_range(lo, hi), cfg).groupBy(*GRAIN).agg(*sum_measures())


def _days(lo: date, hi: date) -> list[date]:
    return [lo + timedelta(days=i) for i in range((hi - lo).days + 1)]


def reconcile_days(spark: SparkSession, store: Store, logs: DataFrame, keys: DataFrame,
                   lo: date, hi: date, cfg: ReportConfig = DEFAULT_CONFIG,
                   lateness: timedelta = LATENESS) -> None:
    publish_days(spark, store, recompute(logs, lo, hi, cfg, lateness), _days(lo, hi), keys, cfg, complete=True)


def mismatched_days(spark: SparkSession, store: Store, logs: DataFrame, lo: date, hi: date,
                    cfg: ReportConfig = DEFAULT_CONFIG, lateness: timedelta = LATENESS) -> DataFrame:
    """Days in [lo, hi] of which some (api_key, model) group differs between log and rollup."""
    def cells(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*GRAIN, *MEASURE_COLS, F.lit(sign).alias("sign"))

    stored = store.rollup(spark).where(F.col("day").between(F.lit(lo), F.lit(hi)))
    both = cells(recompute(logs, lo, hi, cfg, lateness), 1).unionByName(cells(stored, -1))
    return (both.groupBy(*GRAIN, *MEASURE_COLS).agg(F.sum("sign").alias("sign"))
            .where(F.col("sign") != 0).select("day").distinct())


def reconcile_mismatched(spark: SparkSession, store: Store, logs: DataFrame, keys: DataFrame,
                         lo: date, hi: date, cfg: ReportConfig = DEFAULT_CONFIG,
                         lateness: timedelta = LATENESS) -> int:
    """Rewrite only the days that differ (at most those of the look-back range); returns how many.

    After that all days of the range are complete.
    """
    bad = [r["day"] for r in mismatched_days(spark, store, logs, lo, hi, cfg, lateness).collect()]
    if bad:
        publish_days(spark, store, recompute(logs, min(bad), max(bad), cfg, lateness), bad, keys, cfg)
    mark_complete(spark, store, _days(lo, hi))
    return len(bad)
