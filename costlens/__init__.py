"""costlens: LLM request-log spend and budget analytics as Spark jobs.

Every report is computed for all API keys at once from two tables, a
request log (one row per model call) and an API-key dimension.  Operators
are plain DataFrame transformations: DataFrame in, DataFrame out.
"""

from costlens.config import ReportConfig, DEFAULT_CONFIG
from costlens.periods import Period, TimeRange, period_range, month_sql_window

__all__ = [
    "ReportConfig",
    "DEFAULT_CONFIG",
    "Period",
    "TimeRange",
    "period_range",
    "month_sql_window",
]
