"""Per-key spend reports for a period, for every key at once.

* ``total_spend`` (A1): all rows, including NULL/empty models.
* ``by_model`` (A2+A3, X4, A7, W1, F4): model filter F3, per-key normaliser,
  share of the key's total, then rows whose normalised name is empty are
  dropped (their spend stays in the denominator).
* ``by_project`` (A4, F7, W2, X21): one ``global`` bucket, hidden at zero spend.
* ``daily`` (A5, X6, X7): per UTC day; no model filter, no gap filling.

The key universe is the key table (the keys a client can authenticate with).
``one_key`` (F1) narrows any of them to one presented key with a literal filter
that Spark pushes into the scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, GLOBAL_PROJECT, ReportConfig
from costlens.functions.keys import stored_key_text
from costlens.functions.models import has_model, per_key_model
from costlens.functions.money import percent_of, to_double, zero_if_null
from costlens.functions.time import day_start
from costlens.operators.facts import Rollup, facts, money_out, sum_measures
from costlens.operators.keyspace import key_tokens, only_valid_keys
from costlens.periods import period_range, parse_period
from costlens.sources.tables import Tables


def one_key(tables: Tables, key_text: str) -> Tables:
    """restrict both tables to one key (hashed on the driver, X2/X3), so
    log-driven and key-driven reports alike answer for that key only; the
    equality reaches the Parquet scan as a pushed filter."""
    h = stored_key_text(key_text)
    return Tables(tables.logs.where(F.col("api_key") == F.lit(h)),
                  tables.keys.where(F.col("token") == F.lit(h)))


def period_facts(tables: Tables, as_of: datetime, period, cfg: ReportConfig = DEFAULT_CONFIG,
                 rollup: Rollup | None = None) -> DataFrame:
    """Fact rows of the period (from the rollup when given and exact)."""
    return facts(tables.logs, period_range(period, as_of), cfg, rollup)


_period_facts = period_facts


def spend_by_key(tables: Tables, as_of: datetime, period, cfg: ReportConfig = DEFAULT_CONFIG,
                 rollup: Rollup | None = None) -> DataFrame:
    """(api_key, spend) for keys with rows in the period; spend is an exact decimal."""
    return (_period_facts(tables, as_of, period, cfg, rollup)
            .groupBy("api_key").agg(F.sum("spend").alias("spend")))


def total_spend(tables: Tables, as_of: datetime, period, cfg: ReportConfig = DEFAULT_CONFIG,
                rollup: Rollup | None = None) -> DataFrame:
    """A1 + X10: period spend per key; a key without rows gets 0.0."""
    spend = spend_by_key(tables, as_of, period, cfg, rollup)
    return (key_tokens(tables.keys).join(spend, "api_key", "left")
            .select("api_key",
                    F.lit(parse_period(period).value).alias("period"),
                    F.coalesce(to_double(F.col("spend")), F.lit(0.0)).alias("spend")))


def by_model(tables: Tables, as_of: datetime, period, cfg: ReportConfig = DEFAULT_CONFIG,
             rollup: Rollup | None = None) -> DataFrame:
    """Spend, share and tokens per key and normalised model for a period."""
    f = _period_facts(tables, as_of, period, cfg, rollup).where(has_model(F.col("model")))
    agg = (f.groupBy("api_key", per_key_model(F.col("model")).alias("model"))
           .agg(*sum_measures()))
    agg = only_valid_keys(agg, tables.keys)
    # The share's denominator includes names that normalise to '' (dropped after).
    totals = agg.withColumn("key_total", to_double(F.sum("spend").over(Window.partitionBy("api_key"))))
    spend = zero_if_null(F.col("spend"))
    shares = totals.select(
        "api_key", F.lit(parse_period(period).value).alias("period"), "model",
        spend.alias("spend"), percent_of(spend, F.col("key_total")).alias("percentage"),
        "requests", "tokens", "prompt_tokens", "completion_tokens")
    return shares.where(F.col("model") != F.lit(""))


def by_project(tables: Tables, as_of: datetime, period, cfg: ReportConfig = DEFAULT_CONFIG,
               rollup: Rollup | None = None) -> DataFrame:
    """One ``global`` project row per key with non-zero period spend."""
    agg = (_period_facts(tables, as_of, period, cfg, rollup)
           .groupBy("api_key").agg(*sum_measures()))
    agg = only_valid_keys(agg, tables.keys)
    agg = agg.where(F.col("spend").isNotNull() & (F.col("spend") != 0))
    agg = money_out(agg)
    # One bucket per key, so the key's total is its own spend.
    return agg.select("api_key", F.lit(parse_period(period).value).alias("period"),
                      F.lit(GLOBAL_PROJECT).alias("project"), "spend",
                      percent_of(F.col("spend"), F.col("spend")).alias("percentage"),
                      "requests", "tokens", "prompt_tokens", "completion_tokens")


def daily(tables: Tables, as_of: datetime, period, cfg: ReportConfig = DEFAULT_CONFIG,
          rollup: Rollup | None = None) -> DataFrame:
    """Spend, requests and total tokens per key and UTC day (midnight timestamp)."""
    agg = (_period_facts(tables, as_of, period, cfg, rollup)
           .groupBy("api_key", "day").agg(*sum_measures("spend", "requests", "tokens")))
    agg = money_out(only_valid_keys(agg, tables.keys))
    return agg.select("api_key", F.lit(parse_period(period).value).alias("period"),
                      day_start(F.col("day")).alias("date"), "spend", "requests", "tokens")


def order_models(df: DataFrame) -> DataFrame:
    """O1/O2: spend descending per key (name breaks ties)."""
    name = "model" if "model" in df.columns else "project"
    return df.orderBy("api_key", F.desc("spend"), name)


def order_days_desc(df: DataFrame) -> DataFrame:
    """Most recent day first."""
    return df.orderBy("api_key", F.desc("date"))


def order_days_asc(df: DataFrame) -> DataFrame:
    """O3: repository order, oldest day first."""
    return df.orderBy("api_key", "date")


def section_counts(tables: Tables, as_of: datetime, period, cfg: ReportConfig = DEFAULT_CONFIG,
                   rollup: Rollup | None = None) -> DataFrame:
    """Number of models, projects and days per key (0 when a section is empty).

    One scan: facts are aggregated once to (api_key, day, per-key model), and
    the three counts are taken from that: distinct non-empty models among
    rows with a model (as in ``by_model``), 1 project when the key's spend is
    non-zero (``by_project``), distinct days (``daily``).  The sets hold one
    key's model names and days of one period; counting them this way needs one
    further shuffle, where two distinct counts would need an Expand and two.
    """
    f = _period_facts(tables, as_of, period, cfg, rollup)
    g = (f.groupBy("api_key", "day", per_key_model(F.col("model")).alias("name"),
                   has_model(F.col("model")).alias("modelled"))
         .agg(F.sum("spend").alias("spend")))
    counted_model = F.when(F.col("modelled") & (F.col("name") != F.lit("")), F.col("name"))
    per_key = g.groupBy("api_key").agg(
        F.size(F.collect_set(counted_model)).alias("models"),
        F.when(F.sum("spend") != 0, F.lit(1)).otherwise(F.lit(0)).alias("projects"),
        F.size(F.collect_set("day")).alias("days"))
    base = key_tokens(tables.keys).join(per_key, "api_key", "left")
    return base.select("api_key", F.lit(parse_period(period).value).alias("period"),
                       *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                         for c in ("models", "projects", "days")])
