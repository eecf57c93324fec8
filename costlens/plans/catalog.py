"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each runs one report over the whole stand-in tables of ``sf_dir`` with the
fixed clock ``FIXED_AS_OF``; this module only wires inputs to operators.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, FIXED_AS_OF
from costlens.functions.models import all_keys_model, per_key_model
from costlens.operators import (admin, adhoc, allocation, anomalies, auth, breakdowns, budgets, currencies, quality,
                                forecast, reshape, texts, top)
from costlens.functions import display
from costlens.periods import Period, parse_period, valid_period
from costlens.schemas import SPEND_LOGS_SCHEMA
from costlens.session import remove, work_dir
from costlens.sources import load as idempotent
from costlens.sources.layout import read_log_layout, write_log_layout
from costlens.sources.log_table import LogTable
from costlens.sources.sinks import nested, read_csv, write_csv, write_parquet
from costlens.sources.tables import Tables
from costlens.sources.testdata import (faulty_tables, load_auth_attempts, load_rates, load_tables, misdated,
                                       load_period_requests, replayed_batches, spiked, with_teams)
from costlens.streaming import bundle
from costlens.streaming.admission import quarantined
from costlens.streaming.feed import replay
from costlens.streaming.reconcile import reconcile_mismatched
from costlens.streaming.store import Store

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries: the clock, the shared alias used
# by the operator's SQL, one presented key for the single-key report, and the
# stream's landing chunk size and allowed lateness.
AS_OF = FIXED_AS_OF
ALIAS = "engineering"
ONE_KEY = "Bearer sk-user-7"
CHUNK_DAYS = 10
LATENESS = "1 day"
CUSTOM_START = datetime(2024, 1, 10)
PIVOT_MODELS = ["view", "click", "purchase"]
CURRENCIES = ["USD", "GBP", "JPY", "CHF"]
LOADS = 4


def _tables_query(fn) -> Query:
    def run(spark, sf_dir):
        return fn(load_tables(spark, sf_dir))
    return run


def _per_period(fn, period: Period) -> Query:
    return _tables_query(lambda t: fn(t, AS_OF, period, DEFAULT_CONFIG))


# ------------------------------------------------------------------- batch reports
def _budget_resolved(t):
    return budgets.budget_lookup(t.logs.select("api_key").distinct(), t.keys)


def _model_names(t):
    m = F.col("model")
    return (t.logs.select("model").distinct()
            .select(m.alias("model"), per_key_model(m).alias("per_key_model"),
                    all_keys_model(m).alias("all_keys_model")))


def nested_reports(t, as_of, period) -> dict[str, DataFrame]:
    """By model, by project, daily (latest day first) and all keys, a list per valid key."""
    p = parse_period(period).value
    head = t.keys.select(F.col("token").alias("api_key"), F.lit(p).alias("period"))
    spend = -F.col("spend")
    shared = ["spend", "requests", "tokens"]
    split = ["prompt_tokens", "completion_tokens"]
    rows = {"by_model": breakdowns.by_model(t, as_of, period), "by_project": breakdowns.by_project(t, as_of, period),
            "daily": breakdowns.daily(t, as_of, period),
            "all_keys": admin.key_day_model(t, as_of).withColumn("period", F.lit(p))}
    cols = {"by_model": ["model", "percentage", *shared, *split], "by_project": ["project", "percentage", *shared, *split],
            "daily": ["date", *shared], "all_keys": ["day", "model", *shared, *split]}
    order = {"by_model": [spend, F.col("model")], "by_project": [spend, F.col("project")],
             "daily": [-F.unix_date(F.col("date").cast("date"))], "all_keys": [spend, F.col("day"), F.col("model")]}
    return {name: nested(rows[name], ["api_key", "period"], "items", cols[name], order[name], head) for name in rows}


def _nested_report(t):
    return (nested_reports(t, AS_OF, Period.MONTH)["by_model"].withColumnRenamed("items", "models")
            .withColumn("currency", F.lit(DEFAULT_CONFIG.currency)))


def _nested_positions(t):
    """Every list of the nested reports with the place of each item; an empty list gives one row at -1."""
    def flat(name: str, df: DataFrame) -> DataFrame:
        label = {"by_model": "item.model", "by_project": "item.project", "daily": "item.date", "all_keys": "item.model"}[name]
        return (df.select("api_key", F.posexplode_outer("items").alias("pos", "item"))
                .select(F.lit(name).alias("report"), "api_key", F.coalesce("pos", F.lit(-1)).alias("pos"),
                        (F.date_format(label, "yyyy-MM-dd") if name == "daily" else F.col(label)).alias("name"),
                        F.col("item.spend").alias("spend")))

    return reduce(DataFrame.unionByName, [flat(n, df) for n, df in nested_reports(t, AS_OF, Period.MONTH).items()])


def _key_auth(fn) -> Query:
    def run(spark, sf_dir):
        return fn(load_auth_attempts(spark, sf_dir), load_tables(spark, sf_dir).keys)
    return run


# ------------------------------------------------------------------- streaming
def _run_stream(spark, sf_dir, late_first_chunk: bool, shape=lambda df: df) -> Store:
    t = load_tables(spark, sf_dir)
    work = work_dir(spark, "stream")
    store = Store(f"{work}/store")
    lo, hi, _ = replay(spark, t.logs, lambda s: load_tables(s, sf_dir).keys, store, work, CHUNK_DAYS, LATENESS,
                       late_first_chunk, shape=shape)
    if lo is not None and late_first_chunk:
        reconcile_mismatched(spark, store, t.logs, t.keys, lo, hi)
    for used in ("landing", "checkpoint"):
        remove(spark, f"{work}/{used}")
    return store


def _rollup_out(df: DataFrame) -> DataFrame:
    return df.select("day", "api_key", "model", F.col("spend").cast("double").alias("spend"),
                     "requests", "tokens", "prompt_tokens", "completion_tokens")


def _stream_rollup(late_first_chunk: bool) -> Query:
    def run(spark, sf_dir):
        return _rollup_out(_run_stream(spark, sf_dir, late_first_chunk).rollup(spark))
    return run


def _stream_budget_alerts(spark, sf_dir):
    return _run_stream(spark, sf_dir, False).alerts(spark)


def _stream_admission(spark, sf_dir):
    """Some rows are dated years ahead: the rollup holds all the others."""
    return _rollup_out(_run_stream(spark, sf_dir, False, misdated).rollup(spark))


def _stream_quarantine(spark, sf_dir):
    """The rows dated ahead, as they wait in quarantine."""
    store = _run_stream(spark, sf_dir, False, misdated)
    return quarantined(spark, store.root).select("request_id", "api_key", "model", "spend", "startTime")


def _refresh_bundle(spark, sf_dir):
    return bundle.refresh(spark, load_tables(spark, sf_dir), AS_OF, Period.WEEK, work_dir(spark, "bundle"))


def _report_violations(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return quality.report_violations(Tables(faulty_tables(t).logs, t.keys), AS_OF,
                                     work_dir(spark, "violations") + "/rollup")


def _layout_one_key_week(spark, sf_dir):
    """Write the day-partitioned, key-sorted layout, then answer one
    key's weekly by-model report from it (day pruning + key skipping)."""
    t = load_tables(spark, sf_dir)
    path = work_dir(spark, "layout") + "/logs"
    write_log_layout(t.logs, path)
    laid = Tables(read_log_layout(spark, path), t.keys)
    return breakdowns.by_model(breakdowns.one_key(laid, ONE_KEY), AS_OF, Period.WEEK)


def _append_twice(spark, sf_dir):
    """S3: store the log up to the clock, append the replayed batch, append it again, read back."""
    existing, incoming = replayed_batches(load_tables(spark, sf_dir).logs, AS_OF)
    path = work_dir(spark, "append") + "/logs"
    write_parquet(existing, path)
    for _ in range(2):
        idempotent.append_new(path, spark.read.schema(SPEND_LOGS_SCHEMA).parquet(path), incoming)
    return spark.read.schema(SPEND_LOGS_SCHEMA).parquet(path)


def _indexed_load(spark, sf_dir):
    """S3: the loads of ``append_twice`` through the indexed log table."""
    existing, incoming = replayed_batches(load_tables(spark, sf_dir).logs, AS_OF)
    table = LogTable(work_dir(spark, "indexed") + "/logs")
    for rows in (existing, incoming, incoming):
        table.append(spark, rows)
    return table.read(spark).drop("day")


def _compacted_one_key_week(spark, sf_dir):
    """Several loads that touch every day, merged, then one key's weekly report."""
    t = load_tables(spark, sf_dir)
    table = LogTable(work_dir(spark, "compacted") + "/logs")
    for i in range(LOADS):
        table.append(spark, t.logs.where(F.pmod(F.xxhash64("request_id"), F.lit(LOADS)) == i))
    table.compact(spark)
    return breakdowns.by_model(breakdowns.one_key(Tables(table.read(spark), t.keys), ONE_KEY), AS_OF, Period.WEEK)


def _ordered_positions(t):
    """The place of every row of the sorted reports (in its key's list for O3)."""
    def placed(name: str, ordered: DataFrame, key, label) -> DataFrame:
        at = ordered.select(key.alias("api_key"), label.alias("name"), "spend", F.monotonically_increasing_id().alias("at"))
        return at.select(F.lit(name).alias("report"), "api_key",
                         (F.row_number().over(Window.partitionBy("api_key").orderBy("at")) - 1).alias("pos"), "name", "spend")

    alias, day = F.lit(ALIAS), F.date_format("date", "yyyy-MM-dd")
    parts = [placed("days_asc", breakdowns.order_days_asc(breakdowns.daily(t, AS_OF, Period.MONTH)), F.col("api_key"), day),
             placed("alias_by_date", adhoc.order_by_date(adhoc.alias_daily(t, AS_OF, ALIAS)), alias, day),
             placed("alias_by_spend", adhoc.order_by_spend_desc(adhoc.alias_by_model(t, AS_OF, ALIAS)), alias, F.col("model"))]
    return reduce(DataFrame.unionByName, parts)


def _cost_allocation(spark, sf_dir):
    t = with_teams(load_tables(spark, sf_dir))
    out = allocation.cost_allocation(t, AS_OF, Period.MONTH, work_dir(spark, "allocation"))
    shares = ("allocated", "user_allocated", "team_allocated")
    return out.select("team", "user", "api_key", "spend", *[F.col(c).cast("double").alias(c) for c in shares])


def _forecast(t):
    return forecast.forecast(t, AS_OF)


def _csv_export(spark, sf_dir):
    """The daily report and the all-keys report's names written as CSV and read back."""
    t = load_tables(spark, sf_dir)
    report = admin.key_day_model(t, AS_OF)
    path = work_dir(spark, "csv") + "/all_keys"
    write_csv(report, path)
    return read_csv(spark, path, report.schema)


def _period_check(spark, sf_dir):
    asked = load_period_requests(spark, sf_dir)
    return asked.select("request_id", "period", valid_period(F.col("period")).alias("valid"))


def _currencies(spark, sf_dir):
    return currencies.spend_in_currencies(load_tables(spark, sf_dir), load_rates(spark, sf_dir), CURRENCIES, AS_OF)


def registered_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "admin_key_day_model": _tables_query(lambda t: admin.key_day_model(t, AS_OF)),
    }
    for p in Period:
        q[f"total_spend_{p.value}"] = _per_period(breakdowns.total_spend, p)
        q[f"summary_{p.value}"] = _per_period(budgets.summary, p)
    for p in (Period.WEEK, Period.MONTH):
        q[f"by_model_{p.value}"] = _per_period(breakdowns.by_model, p)
        q[f"daily_{p.value}"] = _per_period(breakdowns.daily, p)
    q["by_project_month"] = _per_period(breakdowns.by_project, Period.MONTH)
    q["section_counts"] = _per_period(breakdowns.section_counts, Period.MONTH)
    q["budget_month"] = _tables_query(lambda t: budgets.budget_report(t, AS_OF))
    q["over_budget_keys"] = _tables_query(
        lambda t: budgets.over_budget(budgets.budget_report(t, AS_OF)))
    q["budget_resolved"] = _tables_query(_budget_resolved)
    q["identity"] = _tables_query(lambda t: budgets.identities(t.keys))
    q["alias_keys"] = _tables_query(lambda t: adhoc.alias_keys(t.keys, ALIAS))
    q["alias_month_summary"] = _tables_query(lambda t: adhoc.alias_month_summary(t, AS_OF, ALIAS))
    q["alias_by_model"] = _tables_query(lambda t: adhoc.alias_by_model(t, AS_OF, ALIAS))
    q["alias_daily"] = _tables_query(lambda t: adhoc.alias_daily(t, AS_OF, ALIAS))
    q["key_auth_valid"] = _key_auth(auth.authenticated)
    q["key_auth_rejected"] = _key_auth(auth.rejected)
    q["one_key_by_model"] = _tables_query(
        lambda t: breakdowns.by_model(breakdowns.one_key(t, ONE_KEY), AS_OF, Period.MONTH))
    q["idempotent_load"] = _tables_query(
        lambda t: idempotent.merged(*replayed_batches(t.logs, AS_OF)))
    q["duplicate_request_ids"] = _tables_query(
        lambda t: quality.duplicate_keys(replayed_batches(t.logs, AS_OF)[1], "request_id"))
    q["duplicate_key_tokens"] = _tables_query(lambda t: quality.duplicate_keys(faulty_tables(t).keys, "token"))
    q["model_names"] = _tables_query(_model_names)
    q["admin_cube"] = _tables_query(lambda t: admin.admin_rollup(t, AS_OF))
    q["admin_pivot"] = _tables_query(lambda t: admin.admin_pivot(t, AS_OF, PIVOT_MODELS))
    q["token_breakdown"] = _tables_query(lambda t: texts.token_breakdowns(t, AS_OF))
    q["summary_lines"] = _tables_query(lambda t: reshape.summary_lines(
        budgets.summary(t, AS_OF, Period.MONTH), budgets.budget_report(t, AS_OF)))
    q["status_text"] = _tables_query(lambda t: texts.status_report(t, AS_OF))
    q["breakdown_label"] = _tables_query(
        lambda t: texts.model_labels(breakdowns.by_model(t, AS_OF, Period.MONTH)))
    q["currency_text"] = _tables_query(
        lambda t: texts.budget_money_texts(budgets.budget_report(t, AS_OF)))
    q["daily_label"] = _tables_query(
        lambda t: texts.daily_labels(breakdowns.daily(t, AS_OF, Period.MONTH)))
    q["project_label"] = _tables_query(
        lambda t: texts.project_labels(breakdowns.by_project(t, AS_OF, Period.MONTH)))
    q["state_label"] = _tables_query(lambda t: budgets.budget_report(t, AS_OF).select(
        "api_key", display.state_label(F.col("state")).alias("label"),
        display.state_label_upper(F.col("state")).alias("label_upper")))
    q["report_violations"] = _report_violations
    q["nested_report"] = _tables_query(_nested_report)
    q["nested_positions"] = _tables_query(_nested_positions)
    q["append_twice"] = _append_twice
    q["admin_custom_range"] = _tables_query(
        lambda t: admin.key_day_model(t, AS_OF, start=CUSTOM_START))
    q["layout_one_key_week"] = _layout_one_key_week
    q["stream_daily"] = _stream_rollup(False)
    q["stream_reconcile"] = _stream_rollup(True)
    q["stream_budget_alerts"] = _stream_budget_alerts
    q["refresh_bundle"] = _refresh_bundle
    q["stream_admission"] = _stream_admission
    q["stream_quarantine"] = _stream_quarantine
    q["indexed_load"] = _indexed_load
    q["compacted_one_key_week"] = _compacted_one_key_week
    q["ordered_positions"] = _tables_query(_ordered_positions)
    q["anomalies_month"] = _tables_query(lambda t: anomalies.anomalies(spiked(t), AS_OF))
    q["anomalies_by_model"] = _tables_query(lambda t: anomalies.anomalies(spiked(t), AS_OF, by=["model"]))
    q["top_spenders"] = _tables_query(lambda t: top.top_spenders(t, AS_OF))
    q["top_by_model"] = _tables_query(lambda t: top.top_by_model(t, AS_OF))
    q["team_totals"] = _tables_query(lambda t: allocation.team_totals(with_teams(t), AS_OF))
    q["cost_allocation"] = _cost_allocation
    q["spend_in_currencies"] = _currencies
    q["forecast"] = _tables_query(_forecast)
    q["at_risk"] = _tables_query(lambda t: forecast.newly_at_risk(_forecast(t), budgets.budget_report(t, AS_OF)))
    q["csv_export"] = _csv_export
    q["period_check"] = _period_check
    return q
