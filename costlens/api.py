"""The reference service's endpoints as DataFrames, for all keys or one key.

    reports = SpendReports.from_parquet(spark, "s3://.../spend_logs", "s3://.../keys")
    reports.summary("week")                       # every key
    reports.for_key("Bearer sk-...").by_model()   # one key, filter pushed to the scan
    reports.management_spend(start=datetime(2024, 1, 10))

The clock is fixed when the object is made (``as_of``, naive UTC; default: now
on the driver), so every report of one object uses the same period bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.operators import admin, breakdowns, budgets
from costlens.sources.tables import Tables, read_tables


@dataclass(frozen=True)
class SpendReports:
    tables: Tables
    as_of: datetime
    cfg: ReportConfig = DEFAULT_CONFIG

    @classmethod
    def from_parquet(cls, spark: SparkSession, logs_path: str, keys_path: str,
                     as_of: datetime | None = None, cfg: ReportConfig = DEFAULT_CONFIG) -> "SpendReports":
        now = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
        return cls(read_tables(spark, logs_path, keys_path), now, cfg)

    def for_key(self, key_text: str) -> "SpendReports":
        """Narrow every report to one presented key (``Bearer``/``sk-`` handled)."""
        return replace(self, tables=breakdowns.one_key(self.tables, key_text))

    def summary(self, period: str = "month") -> DataFrame:
        return budgets.summary(self.tables, self.as_of, period, self.cfg)

    def by_model(self, period: str = "month") -> DataFrame:
        return breakdowns.order_models(breakdowns.by_model(self.tables, self.as_of, period, self.cfg))

    def by_project(self, period: str = "month") -> DataFrame:
        return breakdowns.order_models(breakdowns.by_project(self.tables, self.as_of, period, self.cfg))

    def daily(self, period: str = "month") -> DataFrame:
        return breakdowns.order_days_desc(breakdowns.daily(self.tables, self.as_of, period, self.cfg))

    def budget(self) -> DataFrame:
        return budgets.budget_report(self.tables, self.as_of, self.cfg)

    def management_spend(self, start: datetime | None = None,
                         end: datetime | None = None) -> DataFrame:
        """All keys x day x model; unordered, as in the reference."""
        return admin.key_day_model(self.tables, self.as_of, start, end, self.cfg)
