"""Display text as columns.

Amounts use 2 decimals and percentages 1, rounded half away from zero on a
decimal value (the client rounds the binary double; they differ only on exact
binary ties).  Token counts use en-US digit grouping.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from costlens.functions.money import fixed_text

# Currency symbols (others show the code), status-bar formats,
# state icons, status-bar prefixes and tooltip texts per state, token
# breakdown labels and summary line labels.
CURRENCY_SYMBOLS = {"EUR": "€", "USD": "$", "GBP": "£"}
FORMAT_AMOUNT, FORMAT_PERCENTAGE, FORMAT_BOTH = "amount", "percentage", "both"
STATE_ICONS = {"exceeded": "⚠️", "warning": "⚡", "normal": "✓"}
STATUS_PREFIX = {"exceeded": "$(warning) ", "warning": "$(alert) ", "normal": "$(coin) "}
STATE_MESSAGES = {
    "exceeded": "Budget exceeded! Spent {spend} of {budget} ({percent} of monthly budget)",
    "warning": "Budget warning: {percent} of monthly budget used ({spend} of {budget})",
    "normal": "LLM Spend (this month): {spend} of {budget} ({percent})",
}
TOKEN_LABELS = ("Requests", "Total Tokens", "Prompt (In)", "Completion (Out)")
SUMMARY_LABELS = ("Total Spend", "Budget", "Remaining", "Usage", "Budget State")


def fill(template: str, **values: Column) -> Column:
    """A ``{name}`` template as a concat of literal text and columns."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(values[piece])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), fixed_text(c, 2))


def pct(c: Column) -> Column:
    return F.concat(fixed_text(c, 1), F.lit("%"))


def grouped(c: Column) -> Column:
    """Integer with en-US thousands separators (toLocaleString)."""
    return F.format_number(c.cast("bigint"), 0)


def currency_text(amount: Column, currency: Column) -> Column:
    """Symbol for EUR/USD/GBP, else the code, then the amount with 2 decimals."""
    symbol = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCY_SYMBOLS.items() for x in kv]),
                     currency),
        currency)
    return F.concat(symbol, fixed_text(amount, 2))


def status_display(spend: Column, percent: Column, fmt: str) -> Column:
    """``$x.xx`` / ``y.y%`` / ``$x.xx / y.y%``; unknown formats show the amount."""
    if fmt == FORMAT_PERCENTAGE:
        return pct(percent)
    if fmt == FORMAT_BOTH:
        return F.concat(dollars(spend), F.lit(" / "), pct(percent))
    return dollars(spend)


def status_text(state: Column, display: Column) -> Column:
    """Status-bar text: state prefix + display."""
    prefix = (F.when(state == "exceeded", F.lit(STATUS_PREFIX["exceeded"]))
              .when(state == "warning", F.lit(STATUS_PREFIX["warning"]))
              .otherwise(F.lit(STATUS_PREFIX["normal"])))
    return F.concat(prefix, display)


def state_message(state: Column, spend: Column, budget: Column, percent: Column) -> Column:
    """Tooltip text per state (``normal`` for anything else)."""
    v = {"spend": dollars(spend), "budget": dollars(budget), "percent": pct(percent)}
    return (F.when(state == "exceeded", fill(STATE_MESSAGES["exceeded"], **v))
            .when(state == "warning", fill(STATE_MESSAGES["warning"], **v))
            .otherwise(fill(STATE_MESSAGES["normal"], **v)))


def state_label(state: Column) -> Column:
    """Icon and state name (tree view)."""
    icon = (F.when(state == "exceeded", F.lit(STATE_ICONS["exceeded"]))
            .when(state == "warning", F.lit(STATE_ICONS["warning"]))
            .otherwise(F.lit(STATE_ICONS["normal"])))
    return F.concat(icon, F.lit(" "), state)


def state_label_upper(state: Column) -> Column:
    """The state name in capitals (panel view)."""
    return F.upper(state)


def breakdown_description(spend: Column, percentage: Column, tokens: Column) -> Column:
    """``$spend (pct%) · tokens tok``."""
    return F.concat(dollars(spend), F.lit(" ("), pct(percentage), F.lit(") · "), grouped(tokens),
                    F.lit(" tok"))


def breakdown_tooltip(requests: Column, tokens: Column, prompt: Column, completion: Column) -> Column:
    """``n requests, t tokens (in: p, out: c)``."""
    return F.concat(requests.cast("string"), F.lit(" requests, "), grouped(tokens),
                    F.lit(" tokens (in: "), grouped(prompt), F.lit(", out: "), grouped(completion),
                    F.lit(")"))


def daily_label(day: Column, spend: Column) -> Column:
    """Fixed ``yyyy-MM-dd`` date instead of the viewer's locale, then ``$spend``."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), dollars(spend))
