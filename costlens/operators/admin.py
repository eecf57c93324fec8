"""All-keys report (A6, J1, X5, O5) and its re-aggregations.

Plan: scan (range + model filter pushed down) -> partial hash aggregate on
(api_key, day, normalised model) -> shuffle of aggregated rows -> final
aggregate -> LEFT join of the aggregate to the key table for the alias.
Aggregating below the join is exact because ``token`` is the key table's PK,
and a hot key is absorbed by the map-side partial aggregate.  Deliberately
unordered.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.functions.models import all_keys_model, has_model
from costlens.operators.facts import Rollup, facts, money_out, sum_measures
from costlens.operators.keyspace import with_alias
from costlens.periods import TimeRange, admin_range
from costlens.sources.tables import Tables

ADMIN_COLS = ("api_key", "key_alias", "day", "model", "spend", "requests", "tokens",
              "prompt_tokens", "completion_tokens")


def key_day_model_sums(tables: Tables, rng: TimeRange, cfg: ReportConfig = DEFAULT_CONFIG,
                       rollup: Rollup | None = None) -> DataFrame:
    """(api_key, day, normalised model) sums, spend an exact decimal; no alias."""
    f = facts(tables.logs, rng, cfg, rollup).where(has_model(F.col("model")))
    return (f.groupBy("api_key", "day", all_keys_model(F.col("model")).alias("model"))
            .agg(*sum_measures()))


def key_day_model_exact(tables: Tables, rng: TimeRange, cfg: ReportConfig = DEFAULT_CONFIG,
                        rollup: Rollup | None = None) -> DataFrame:
    """A6 with spend still an exact decimal (for further re-aggregation)."""
    agg = key_day_model_sums(tables, rng, cfg, rollup)
    return with_alias(agg, tables.keys).select(*ADMIN_COLS)


def key_day_model(tables: Tables, as_of: datetime, start: datetime | None = None,
                  end: datetime | None = None, cfg: ReportConfig = DEFAULT_CONFIG,
                  rollup: Rollup | None = None) -> DataFrame:
    """One row per (api_key, day, model); X9 range defaults to the month."""
    rng = admin_range(as_of, start, end)
    return money_out(key_day_model_exact(tables, rng, cfg, rollup))


def admin_rollup(tables: Tables, as_of: datetime, cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """R2: the all-keys rows re-aggregated by each pair, each column and overall.

    Runs on the aggregated rows (not the log), as GROUPING SETS; ``grouping_id``
    has one bit per column (api_key, day, model), set when rolled up.
    """
    rows = key_day_model_sums(tables, admin_range(as_of), cfg)
    g = rows.groupingSets([["api_key", "day"], ["api_key", "model"], ["day", "model"],
                           ["api_key"], ["day"], ["model"], []], "api_key", "day", "model").agg(
        F.grouping_id("api_key", "day", "model").cast("int").alias("grouping_id"),
        *sum_measures())
    return money_out(g).select("grouping_id", "api_key", "day", "model", "spend", "requests",
                               "tokens", "prompt_tokens", "completion_tokens")


def admin_pivot(tables: Tables, as_of: datetime, models: list[str],
                cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per (api_key, day), one spend column per declared model name.

    The columns are declared, so the schema does not follow the data;
    ``other_models`` holds the spend of all further names, so none is lost.
    """
    rows = key_day_model_sums(tables, admin_range(as_of), cfg)
    other = ~F.col("model").isin(*models) if models else F.lit(True)
    return rows.groupBy("api_key", "day").agg(
        *[F.sum(F.when(F.col("model") == F.lit(m), F.col("spend"))).cast("double").alias(m) for m in models],
        F.sum(F.when(other, F.col("spend"))).cast("double").alias("other_models"))
