"""The client's five-report refresh as one batch job.

One scan of the log builds the (day, api_key, raw model) rollup for the union
of the needed ranges (a week may start in the previous month), cut from its
lineage by writing it under the shared checkpoint folder.  The five reports
are then derived from that small table and written concurrently; a failing
report does not stop the others, and each gets a status row.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.operators import breakdowns, budgets
from costlens.functions.money import zero_if_null
from costlens.operators.facts import ROLLUP_SCHEMA, Rollup, daily_rollup
from costlens.periods import Period, TimeRange, parse_period, period_range
from costlens.sources.tables import Tables

REPORTS = ("summary", "by_model", "by_project", "daily", "budget")
STATUS_SCHEMA = "report string, ok boolean, error string, rows bigint, spend double"


def shared_range(as_of: datetime, period) -> TimeRange:
    """The union of the period's range and the budget's month."""
    p, m = period_range(period, as_of), period_range(Period.MONTH, as_of)
    return TimeRange(min(p.start, m.start), max(p.end, m.end))


def report(name: str, tables: Tables, rollup: Rollup, as_of: datetime, period,
           cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """One of the five reports, served from the shared rollup."""
    p = parse_period(period)
    if name == "budget":
        return budgets.budget_report(tables, as_of, cfg, rollup)
    made = {"summary": budgets.summary, "by_model": breakdowns.by_model,
            "by_project": breakdowns.by_project, "daily": breakdowns.daily}[name]
    return made(tables, as_of, p, cfg, rollup)


def refresh(spark: SparkSession, tables: Tables, as_of: datetime, period, out_dir: str,
            cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """Write the five reports under ``out_dir``; return one status row per report.

    A report that cannot be built, written or read back does not stop the others.
    """
    rng = shared_range(as_of, period)
    rollup_path = f"{out_dir}/_rollup"
    daily_rollup(tables.logs, rng, cfg).write.mode("overwrite").parquet(rollup_path)
    rollup = Rollup(spark.read.schema(ROLLUP_SCHEMA).parquet(rollup_path), rng.first_day, rng.last_day)

    def write(name: str) -> DataFrame:
        try:
            made = report(name, tables, rollup, as_of, period, cfg)
            made.write.mode("overwrite").parquet(f"{out_dir}/{name}")
            amount = F.col("spent" if name == "budget" else "spend").cast(cfg.money_type)
            return (spark.read.schema(made.schema).parquet(f"{out_dir}/{name}")
                    .agg(F.count(F.lit(1)).alias("rows"), zero_if_null(F.sum(amount)).alias("spend"))
                    .select(F.lit(name).alias("report"), F.lit(True).alias("ok"),
                            F.lit(None).cast("string").alias("error"), "rows", "spend"))
        except Exception as e:  # noqa: BLE001 - a failed report is reported, not raised
            return spark.createDataFrame([(name, False, f"{type(e).__name__}: {e}", None, None)], STATUS_SCHEMA)

    with ThreadPoolExecutor(max_workers=len(REPORTS)) as pool:
        return reduce(DataFrame.unionByName, pool.map(write, REPORTS))
