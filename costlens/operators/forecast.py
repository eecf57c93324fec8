"""Month-end forecast: spend of the complete days so far plus a daily rate for the days to come.

Complete days are those before ``as_of``'s day.  The daily rate is the mean over
the last ``window`` complete days, days without a row counting as zero; they may
lie in the month before.  Both sums come from one scan and one aggregate per
key.  Keys are those of the key table; one without spend is forecast at zero.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, STATE_EXCEEDED, STATE_NORMAL, STATE_WARNING, ReportConfig
from costlens.functions.money import percent_of, to_double
from costlens.operators.budgets import budget_state, key_budgets
from costlens.operators.facts import Rollup, facts
from costlens.periods import day_range, next_month_start
from costlens.sources.tables import Tables

WINDOW = 7


def forecast(tables: Tables, as_of: datetime, window: int = WINDOW, cfg: ReportConfig = DEFAULT_CONFIG,
             rollup: Rollup | None = None) -> DataFrame:
    """``(api_key, spent, daily_rate, projected, budget, projected_percent, projected_state, exceeded_on)``.

    ``exceeded_on`` is the first day on which the spend reaches the budget at
    the daily rate, NULL if that is not in this month.  A budget that the complete
    days have used up is exceeded on the last of them at the latest, and that day is given.
    """
    today = as_of.date()
    month, last = today.replace(day=1), today - timedelta(days=1)
    since = today - timedelta(days=window)
    to_come = (next_month_start(month) - today).days
    zero = F.lit(0).cast(cfg.money_type)
    day = F.col("day")
    rows = facts(tables.logs, day_range(min(month, since), last), cfg, rollup)
    sums = rows.groupBy("api_key").agg(F.sum(F.when(day >= F.lit(month), F.col("spend")).otherwise(zero)).alias("spent"),
                                       F.sum(F.when(day >= F.lit(since), F.col("spend")).otherwise(zero)).alias("recent"))
    out = (key_budgets(tables.keys, cfg).select("api_key", "budget").join(sums, "api_key", "left")
           .withColumns({"spent": F.coalesce(to_double(F.col("spent")), F.lit(0.0)),
                         "daily_rate": F.coalesce(to_double(F.col("recent")), F.lit(0.0)) / window})
           .withColumn("projected", F.col("spent") + F.col("daily_rate") * to_come))
    percent = percent_of(F.col("projected"), F.col("budget"))
    missing = F.col("budget") - F.col("spent")
    days = (F.when(missing <= 0, F.lit(0))
            .when(F.col("daily_rate") > 0, F.ceil(missing / F.nullif(F.col("daily_rate"), F.lit(0.0))).try_cast("int")))
    reached = F.when(days <= to_come, F.date_add(F.lit(last), days))
    return out.select("api_key", "spent", "daily_rate", "projected", "budget", percent.alias("projected_percent"),
                      budget_state(percent, cfg).alias("projected_state"), reached.alias("exceeded_on"))


def newly_at_risk(forecasts: DataFrame, budget: DataFrame) -> DataFrame:
    """Keys whose state at the month's end is forecast to be worse than now."""
    now = budget.select("api_key", F.col("state").alias("state_now"))
    worse = (F.col("projected_state") == STATE_EXCEEDED) & (F.col("state_now") != STATE_EXCEEDED)
    worse = worse | (F.col("projected_state") == STATE_WARNING) & (F.col("state_now") == STATE_NORMAL)
    return (forecasts.where(F.col("projected_state") != STATE_NORMAL).join(now, "api_key").where(worse)
            .select("api_key", "state_now", "projected_state", "projected", "budget", "exceeded_on"))
