"""Spend in other currencies, at the rate of its day or the last one before it.

Rates are dated and need not exist for every day.  Instead of a range join each
rate is written out for the days of the report on which it holds (until the next
rate of its currency), which gives one row per currency and day; daily sums then
meet it by equality.  Days before a currency's first rate have none.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.operators.breakdowns import period_facts
from costlens.operators.facts import Rollup
from costlens.periods import Period, TimeRange, period_range
from costlens.sources.tables import Tables

#: Types of a converted amount's factors; their product fits 38 digits.
AMOUNT, RATE = "decimal(20,8)", "decimal(12,6)"


def rate_days(rates: DataFrame, rng: TimeRange) -> DataFrame:
    """``(currency, day, rate)`` for each day of the range, from ``rates (currency, day, rate)``.

    Of several rates for one day the greatest holds; rows without a currency,
    day or rate do not count.
    """
    given = (rates.where("currency IS NOT NULL AND day IS NOT NULL AND rate IS NOT NULL")
             .groupBy("currency", "day").agg(F.max(F.col("rate").cast(RATE)).alias("rate")))
    until = F.date_sub(F.lead("day").over(Window.partitionBy("currency").orderBy("day")), 1)
    first, last = F.lit(rng.first_day), F.lit(rng.last_day)
    spans = given.withColumns({"since": F.greatest("day", first), "until": F.least(F.coalesce(until, last), last)})
    return (spans.where(F.col("since") <= F.col("until"))
            .select("currency", F.explode(F.sequence("since", "until", F.expr("INTERVAL 1 DAY"))).alias("day"), "rate"))


def spend_in_currencies(tables: Tables, rates: DataFrame, currencies: Sequence[str], as_of: datetime, period=Period.MONTH,
                        cfg: ReportConfig = DEFAULT_CONFIG, rollup: Rollup | None = None) -> DataFrame:
    """``(api_key, currency, converted, without_rate)`` per key and currency.

    ``converted`` is NULL if no day of the key has a rate; ``without_rate`` is
    the spend, in the log's currency, of the days that have none.
    """
    daily = (period_facts(tables, as_of, period, cfg, rollup).groupBy("api_key", "day").agg(F.sum("spend").alias("spend"))
             .withColumn("spend", F.coalesce("spend", F.lit(0)).cast(AMOUNT))
             .withColumn("currency", F.explode(F.array(*map(F.lit, currencies)))))
    known = rate_days(rates.where(F.col("currency").isin(*currencies)), period_range(period, as_of))
    met = daily.join(known, ["currency", "day"], "left")
    missing = F.when(F.col("rate").isNull(), F.col("spend")).otherwise(F.lit(0).cast(AMOUNT))
    return (met.groupBy("api_key", "currency")
            .agg(F.sum(F.col("spend") * F.col("rate")).cast("double").alias("converted"), F.sum(missing).cast("double").alias("without_rate")))
