"""Validation as data (V1, V3): violating rows, never a failed job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG
from costlens.operators import admin, breakdowns, budgets
from costlens.operators.facts import ROLLUP_SCHEMA, Rollup, daily_rollup
from costlens.periods import period_range

# Fixed rules of the report models: field -> (min, max); None = unbounded.
LOG_RULES = {"spend": (0, None)}
SUMMARY_RULES = {"spend": (0, None), "budget": (0, None), "budget_used_percent": (0, None)}
SHARE_RULES = {"spend": (0, None), "percentage": (0, 100), "requests": (0, None),
               "tokens": (0, None), "prompt_tokens": (0, None), "completion_tokens": (0, None)}
DAILY_RULES = {"spend": (0, None), "requests": (0, None), "tokens": (0, None)}
BUDGET_RULES = {"monthly_budget": (0, None), "spent": (0, None), "used_percent": (0, None),
                "warning_threshold": (0, 100), "exceeded_threshold": (0, 100)}
ADMIN_RULES = DAILY_RULES | {"prompt_tokens": (0, None), "completion_tokens": (0, None)}


def _fails(c: Column, lo, hi) -> Column:
    """A missing value and NaN break every rule."""
    cond = c.isNull() | F.isnan(c.cast("double"))
    if lo is not None:
        cond = cond | (c < F.lit(lo))
    if hi is not None:
        cond = cond | (c > F.lit(hi))
    return cond


def violations(report: DataFrame, report_name: str, rules: dict, id_col: str = "api_key") -> DataFrame:
    """One row per (row, broken rule): report, id, field, value.

    A single pass over the report: every rule becomes one element of an array
    of (field, value, failed) structs that is exploded and filtered, so the
    report is computed once however many rules there are.
    """
    checks = F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(field).cast("double").alias("value"),
                 _fails(F.col(field), lo, hi).alias("failed"))
        for field, (lo, hi) in rules.items()])
    return (report.select(F.col(id_col).cast("string").alias("row_id"),
                          F.explode(checks).alias("c"))
            .where(F.col("c.failed"))
            .select(F.lit(report_name).alias("report"), "row_id",
                    F.col("c.field").alias("field"), F.col("c.value").alias("value")))


def all_violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, pk: str) -> DataFrame:
    """V3: primary-key values that occur more than once, with their count."""
    return df.groupBy(pk).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def report_violations(tables, as_of, rollup_path: str, cfg=None) -> DataFrame:
    """V1 over the month's log rows and its six reports.

    The reports are answered from one (day, api_key, raw model) rollup of the
    month, written to ``rollup_path``, so the log is aggregated once.  Amounts
    that are missing or NaN count as 0 in reports; the log rows themselves are
    checked so that they show.
    """
    cfg = cfg or DEFAULT_CONFIG
    rng = period_range("month", as_of)
    daily_rollup(tables.logs, rng, cfg).write.mode("overwrite").parquet(rollup_path)
    roll = Rollup(tables.logs.sparkSession.read.schema(ROLLUP_SCHEMA).parquet(rollup_path), rng.first_day, rng.last_day)
    return all_violations([
        violations(tables.logs.where(rng.contains(F.col("startTime"))), "log", LOG_RULES, "request_id"),
        violations(budgets.summary(tables, as_of, "month", cfg, roll), "summary", SUMMARY_RULES),
        violations(breakdowns.by_model(tables, as_of, "month", cfg, roll), "by_model", SHARE_RULES),
        violations(breakdowns.by_project(tables, as_of, "month", cfg, roll), "by_project", SHARE_RULES),
        violations(breakdowns.daily(tables, as_of, "month", cfg, roll), "daily", DAILY_RULES),
        violations(budgets.budget_report(tables, as_of, cfg, roll), "budget", BUDGET_RULES),
        violations(admin.key_day_model(tables, as_of, cfg=cfg, rollup=roll), "admin", ADMIN_RULES),
    ])
