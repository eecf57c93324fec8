"""Exact money sums, safe division, rounding, NULL-to-zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig


def exact_money(c: Column, cfg: ReportConfig = DEFAULT_CONFIG) -> Column:
    """Spend as an exact decimal, so sums do not depend on row order."""
    return c.cast(cfg.money_type)


def to_double(c: Column) -> Column:
    return c.cast("double")


def zero_if_null(c: Column, dtype: str = "double") -> Column:
    """``float(x or 0)`` / ``int(x or 0)``."""
    return F.coalesce(c, F.lit(0)).cast(dtype)


def safe_div(num: Column, den: Column) -> Column:
    """NULL when the divisor is 0 or NULL (ANSI mode would raise on /0)."""
    return num / F.nullif(den, F.lit(0))


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole * 100, or 0.0 when whole <= 0 (or NULL)."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def round_half_up(c: Column, places: int) -> Column:
    """X11: ROUND(x::numeric, n) - half away from zero on a decimal value."""
    return F.round(c.cast("decimal(38,18)"), places)


def fixed_text(c: Column, places: int) -> Column:
    """Number as text with exactly ``places`` decimals (no grouping).

    Rounds on a decimal value (half away from zero) instead of the binary
    double, so the text is the same whichever engine formats it.
    """
    return round_half_up(c, places).cast(f"decimal(38,{places})").cast("string")
