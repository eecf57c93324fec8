"""Top spenders: the keys, or the keys of each group, that spent most in a period.

Spend is summed first (partial sums in each task), then only the first ``k`` are
kept: over all keys by a bounded heap in every task whose contents are merged
(``TakeOrderedAndProject``), in groups by a rank limit that runs in every task
before the shuffle, so that a task sends at most ``k`` rows of a group however
many keys a group holds.  Nothing is sorted globally.

Equal spend is ordered by key, so the result is the same whatever the plan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.functions.models import all_keys_model, has_model
from costlens.operators.breakdowns import period_facts, spend_by_key
from costlens.operators.facts import Rollup, money_out
from costlens.operators.keyspace import with_alias
from costlens.periods import Period
from costlens.sources.tables import Tables

TOP, TOP_IN_GROUP = 20, 3


def first_in_groups(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; ``order`` must tell all rows of a group apart."""
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
            .where(F.col("rank") <= k))


def top_spenders(tables: Tables, as_of: datetime, period=Period.MONTH, k: int = TOP, cfg: ReportConfig = DEFAULT_CONFIG,
                 rollup: Rollup | None = None) -> DataFrame:
    """``(rank, api_key, key_alias, spend)`` of the ``k`` keys with the most spend; no spend is no rank."""
    spend = spend_by_key(tables, as_of, period, cfg, rollup).where(F.col("spend") != 0)
    order = [F.desc("spend"), F.col("api_key")]
    first = spend.orderBy(*order).limit(k)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over k rows
    return money_out(with_alias(ranked, tables.keys)).select("rank", "api_key", "key_alias", "spend")


def top_by_model(tables: Tables, as_of: datetime, period=Period.MONTH, k: int = TOP_IN_GROUP, cfg: ReportConfig = DEFAULT_CONFIG,
                 rollup: Rollup | None = None) -> DataFrame:
    """``(model, rank, api_key, spend)``: the ``k`` keys with the most spend on each model."""
    rows = period_facts(tables, as_of, period, cfg, rollup).where(has_model(F.col("model")))
    sums = rows.groupBy(all_keys_model(F.col("model")).alias("model"), "api_key").agg(F.sum("spend").alias("spend")).where(F.col("spend") != 0)
    first = first_in_groups(sums, ["model"], [F.desc("spend"), F.col("api_key")], k)
    return money_out(first).select("model", "rank", "api_key", "spend")
