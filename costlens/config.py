"""Report settings passed explicitly to operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

# Fixed values that results depend on (defaults of the spend service):
# default monthly budget 25.0, currency EUR, warning at 80 %, exceeded at 100 %,
# budget state names normal / warning / exceeded, project bucket "global".
DEFAULT_MONTHLY_BUDGET = 25.0
DEFAULT_CURRENCY = "EUR"
WARNING_THRESHOLD = 80.0
EXCEEDED_THRESHOLD = 100.0
STATE_NORMAL = "normal"
STATE_WARNING = "warning"
STATE_EXCEEDED = "exceeded"
GLOBAL_PROJECT = "global"

# Fixed clock used by the registered queries and tests (a Wednesday).
FIXED_AS_OF = datetime(2024, 1, 17, 15, 30, 0)


@dataclass(frozen=True)
class ReportConfig:
    default_budget: float = DEFAULT_MONTHLY_BUDGET
    currency: str = DEFAULT_CURRENCY
    warning_threshold: float = WARNING_THRESHOLD
    exceeded_threshold: float = EXCEEDED_THRESHOLD
    # Money is summed as an exact decimal and turned into double once at the end,
    # so totals do not depend on the order rows reach the aggregate.  18 places
    # keep the smallest per-token prices; sums have 20 digits before the point.
    money_type: str = "decimal(28,18)"


DEFAULT_CONFIG = ReportConfig()
