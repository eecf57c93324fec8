"""Budgets (B1-B7, F6, F8, J5) and the per-period summary.

The cap is the key's flat ``max_budget`` when it is > 0; NULL, 0, a negative
value or a missing key row all fall back to the default budget.  Spend for the
budget report is always the calendar month of ``as_of``; the summary's spend
follows the chosen period while its budget stays the monthly cap.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.config import (DEFAULT_CONFIG, STATE_EXCEEDED, STATE_NORMAL, STATE_WARNING,
                             ReportConfig)
from costlens.functions.keys import (email_from_metadata, identity_email, identity_id,
                                     key_prefix_mask)
from costlens.functions.money import percent_of, to_double
from costlens.operators.breakdowns import spend_by_key
from costlens.operators.facts import Rollup
from costlens.periods import Period, parse_period
from costlens.sources.tables import Tables


def resolve_budget(max_budget: Column, cfg: ReportConfig = DEFAULT_CONFIG) -> Column:
    """Usable only when not NULL and > 0."""
    return F.when(max_budget > 0, max_budget.cast("double")).otherwise(F.lit(cfg.default_budget))


def budget_state(used_percent: Column, cfg: ReportConfig = DEFAULT_CONFIG) -> Column:
    """>= exceeded, else >= warning, else normal (inclusive bounds)."""
    return (F.when(used_percent >= F.lit(cfg.exceeded_threshold), F.lit(STATE_EXCEEDED))
            .when(used_percent >= F.lit(cfg.warning_threshold), F.lit(STATE_WARNING))
            .otherwise(F.lit(STATE_NORMAL)))


def key_budgets(keys: DataFrame, cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """Resolved cap and identity id for every key row."""
    return keys.select(
        F.col("token").alias("api_key"),
        identity_id(F.col("user_id"), F.col("token")).alias("user_id"),
        resolve_budget(F.col("max_budget"), cfg).alias("budget"),
    )


def budget_lookup(requested: DataFrame, keys: DataFrame,
                  cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """Cap for each requested ``api_key``; default when the key row is missing.

    ``budget_source`` says which branch applied: ``max_budget``,
    ``default_unset`` (row present, cap NULL/<= 0) or ``default_missing_key``.
    """
    k = keys.select(F.col("token").alias("api_key"), F.col("max_budget"),
                    F.lit(True).alias("_found"))
    j = requested.select("api_key").join(k, "api_key", "left")
    source = (F.when(F.col("_found").isNull(), F.lit("default_missing_key"))
              .when(F.col("max_budget") > 0, F.lit("max_budget"))
              .otherwise(F.lit("default_unset")))
    return j.select("api_key", resolve_budget(F.col("max_budget"), cfg).alias("max_budget"),
                    source.alias("budget_source"), F.lit(cfg.currency).alias("currency"))


def summary(tables: Tables, as_of: datetime, period, cfg: ReportConfig = DEFAULT_CONFIG,
            rollup: Rollup | None = None) -> DataFrame:
    """Period spend against the monthly cap (B2 remaining, B3 used %)."""
    spend = spend_by_key(tables, as_of, period, cfg, rollup)
    j = (key_budgets(tables.keys, cfg).join(spend, "api_key", "left")
         .withColumn("spend", F.coalesce(to_double(F.col("spend")), F.lit(0.0))))
    return j.select(
        "api_key", "user_id",
        F.lit(parse_period(period).value).alias("period"),
        F.lit(cfg.currency).alias("currency"),
        "spend", "budget",
        (F.col("budget") - F.col("spend")).alias("remaining"),
        percent_of(F.col("spend"), F.col("budget")).alias("budget_used_percent"),
    )


def budget_report(tables: Tables, as_of: datetime, cfg: ReportConfig = DEFAULT_CONFIG,
                  rollup: Rollup | None = None) -> DataFrame:
    """Month-to-date spend, cap, remaining, used %, state and both thresholds."""
    s = summary(tables, as_of, Period.MONTH, cfg, rollup)
    used = F.col("budget_used_percent")
    return s.select(
        "api_key", "user_id",
        F.col("budget").alias("monthly_budget"),
        "currency",
        F.col("spend").alias("spent"),
        "remaining",
        used.alias("used_percent"),
        budget_state(used, cfg).alias("state"),
        F.lit(cfg.warning_threshold).alias("warning_threshold"),
        F.lit(cfg.exceeded_threshold).alias("exceeded_threshold"),
    )


def over_budget(budget: DataFrame) -> DataFrame:
    """F8 + B7: keys in warning or exceeded, with both predicates as flags."""
    st = F.col("state")
    return (budget.where(st.isin(STATE_WARNING, STATE_EXCEEDED))
            .select("api_key", "user_id", "state", "used_percent", "remaining",
                    st.isin(STATE_WARNING, STATE_EXCEEDED).alias("is_warning"),
                    (st == F.lit(STATE_EXCEEDED)).alias("is_exceeded")))


def identities(keys: DataFrame) -> DataFrame:
    """Identity of every key row (id, email, masked token)."""
    ident = identity_id(F.col("user_id"), F.col("token"))
    return keys.select(
        F.col("token").alias("api_key"),
        ident.alias("user_id"),
        identity_email(email_from_metadata(F.col("metadata")), ident).alias("email"),
        key_prefix_mask(F.col("token")).alias("key_prefix"),
    )
