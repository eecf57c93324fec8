"""The operator's ad-hoc reconciliation reports for one key alias.

An alias is not unique: every key sharing it is included.  The month window is
the SQL one, which ends at 23:59:59 flat (X22).  Values are rounded half away
from zero on decimals (X11); division by a 0/NULL cap gives NULL (X12).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.functions.models import has_model
from costlens.functions.money import round_half_up, safe_div, to_double
from costlens.operators.facts import log_facts, sum_measures
from costlens.periods import month_sql_window
from costlens.sources.tables import Tables


def alias_keys(keys: DataFrame, alias: str) -> DataFrame:
    """the key rows carrying ``alias``."""
    return keys.where(F.col("key_alias") == F.lit(alias)) \
        .select("token", "user_id", "key_alias", "max_budget", "spend")


def _alias_facts(tables: Tables, as_of: datetime, alias: str, cfg: ReportConfig) -> DataFrame:
    """The month's fact rows of the alias' keys only: they are picked before any aggregate."""
    tokens = tables.keys.where(F.col("key_alias") == F.lit(alias)).select(F.col("token").alias("api_key"))
    return log_facts(tables.logs, month_sql_window(as_of), cfg).join(tokens, "api_key", "left_semi")


def alias_month_summary(tables: Tables, as_of: datetime, alias: str,
                        cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per key of the alias, month spend beside the proxy's own counter.

    The correlated LATERAL sub-query is written decorrelated: aggregate the
    alias' month by key once, then LEFT join from the alias' key rows.
    """
    month = (_alias_facts(tables, as_of, alias, cfg)
             .groupBy("api_key").agg(F.sum("spend").alias("month_spend")))
    k = tables.keys.where(F.col("key_alias") == F.lit(alias))
    j = k.join(month, k["token"] == month["api_key"], "left")
    spent = F.coalesce(F.col("month_spend"), F.lit(0).cast(cfg.money_type))
    cap = F.col("max_budget").cast(cfg.money_type)
    return j.select(
        "token", "key_alias", "max_budget",
        F.col("spend").alias("proxy_counter"),
        to_double(round_half_up(spent, 4)).alias("month_spend"),
        to_double(round_half_up(cap - spent, 4)).alias("remaining"),
        to_double(round_half_up(safe_div(spent.cast("double"), F.col("max_budget")) * 100.0, 2))
        .alias("used_percent"),
    )


def alias_by_model(tables: Tables, as_of: datetime, alias: str,
                   cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """Month spend of the alias' keys per **raw** model.

    ``requests`` counts request ids, which equals the SQL's COUNT(*) because
    request_id is never NULL.
    """
    g = (_alias_facts(tables, as_of, alias, cfg).where(has_model(F.col("model")))
         .groupBy("model").agg(*sum_measures("spend", "requests", "tokens")))
    return g.select("model", to_double(round_half_up(F.col("spend"), 4)).alias("spend"),
                    "requests", F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"))


def alias_daily(tables: Tables, as_of: datetime, alias: str,
                cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """Month spend of the alias' keys per UTC day (all models)."""
    g = (_alias_facts(tables, as_of, alias, cfg)
         .groupBy("day").agg(*sum_measures("spend", "requests", "tokens")))
    return g.select(F.col("day").alias("date"),
                    to_double(round_half_up(F.col("spend"), 4)).alias("spend"),
                    "requests", F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"))


def order_by_date(df: DataFrame) -> DataFrame:
    """The alias' days, oldest first."""
    return df.orderBy("date")


def order_by_spend_desc(df: DataFrame) -> DataFrame:
    """Sorted on the rounded spend, as the SQL does."""
    return df.orderBy(F.desc("spend"), "model")
