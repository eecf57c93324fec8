"""Report text columns for the status bar and tree view."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, GLOBAL_PROJECT, ReportConfig
from costlens.functions import display as D
from costlens.functions.models import has_model, per_key_model
from costlens.operators import breakdowns, budgets
from costlens.operators.facts import sum_measures
from costlens.operators.keyspace import only_valid_keys
from costlens.operators.reshape import token_breakdown
from costlens.periods import Period
from costlens.sources.tables import Tables


def status_report(tables: Tables, as_of: datetime, period=Period.MONTH,
                  cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """Status-bar text in the three formats plus the tooltip, per key.

    X18: the monthly budget figures are shown when a budget row exists, else
    the period summary's figures.
    """
    s = budgets.summary(tables, as_of, period, cfg)
    b = budgets.budget_report(tables, as_of, cfg).select(
        "api_key", "state", "spent", "used_percent", "monthly_budget")
    j = s.join(b, "api_key", "left")
    spend = F.coalesce(F.col("spent"), F.col("spend"))
    percent = F.coalesce(F.col("used_percent"), F.col("budget_used_percent"))
    cap = F.coalesce(F.col("monthly_budget"), F.col("budget"))
    st = F.col("state")
    return j.select(
        "api_key", st.alias("state"),
        D.status_text(st, D.status_display(spend, percent, D.FORMAT_AMOUNT)).alias("text_amount"),
        D.status_text(st, D.status_display(spend, percent, D.FORMAT_PERCENTAGE))
         .alias("text_percentage"),
        D.status_text(st, D.status_display(spend, percent, D.FORMAT_BOTH)).alias("text_both"),
        D.state_message(st, spend, cap, percent).alias("tooltip"))


def model_labels(by_model: DataFrame) -> DataFrame:
    """Description and tooltip of each model row."""
    return by_model.select(
        "api_key", "model",
        D.breakdown_description(F.col("spend"), F.col("percentage"), F.col("tokens"))
         .alias("description"),
        D.breakdown_tooltip(F.col("requests"), F.col("tokens"), F.col("prompt_tokens"),
                            F.col("completion_tokens")).alias("tooltip"))


def project_labels(by_project: DataFrame) -> DataFrame:
    """Description and tooltip of each project row."""
    return model_labels(by_project.withColumnRenamed("project", "model")).withColumnRenamed("model", "project")


def budget_money_texts(budget: DataFrame, other_currencies: tuple[str, str] = ("USD", "CHF")) -> DataFrame:
    """Amounts of the budget report as currency text (configured and two others)."""
    a, b = other_currencies
    return budget.select(
        "api_key", "currency",
        D.currency_text(F.col("spent"), F.col("currency")).alias("spent_text"),
        D.currency_text(F.col("remaining"), F.lit(a)).alias(f"remaining_{a.lower()}_text"),
        D.currency_text(F.col("monthly_budget"), F.lit(b)).alias(f"budget_{b.lower()}_text"))


def daily_labels(daily: DataFrame) -> DataFrame:
    """One label per daily row."""
    return daily.select("api_key", "date", D.daily_label(F.col("date"), F.col("spend")).alias("label"))


def token_breakdowns(tables: Tables, as_of: datetime, period=Period.MONTH,
                     cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """R1 for both the model rows and the project row of each key, in one pass.

    The rows are the same as ``by_model`` + ``by_project`` give (their token
    columns do not need the share).  One scan feeds one GROUPING SETS
    aggregate: (api_key, model name) for the model rows, with the name NULL
    when F3 excludes the row, and (api_key) for the single ``global`` project.
    The per-kind rules then apply as one filter: F4 drops empty names, F7
    hides a project at zero spend.
    """
    f = breakdowns.period_facts(tables, as_of, period, cfg)
    name = F.when(has_model(F.col("model")), per_key_model(F.col("model")))
    g = (f.withColumn("name", name)
         .groupingSets([["api_key", "name"], ["api_key"]], "api_key", "name")
         .agg(F.grouping("name").cast("int").alias("gid"), *sum_measures()))
    g = only_valid_keys(g, tables.keys)
    is_model = F.col("gid") == 0
    keep = ((is_model & F.col("name").isNotNull() & (F.col("name") != F.lit("")))
            | (~is_model & F.col("spend").isNotNull() & (F.col("spend") != 0)))
    rows = g.where(keep).select(
        "api_key",
        F.when(is_model, F.lit("model")).otherwise(F.lit("project")).alias("kind"),
        F.when(is_model, F.col("name")).otherwise(F.lit(GLOBAL_PROJECT)).alias("name"),
        "requests", "tokens", "prompt_tokens", "completion_tokens")
    return token_breakdown(rows.withColumnRenamed("name", "_name"), "_name", None)
