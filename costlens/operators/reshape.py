"""Reshaping for display (R1, R4) and the text columns built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions.display import SUMMARY_LABELS, TOKEN_LABELS, dollars, pct, state_label

_TOKEN_COLS = ("requests", "tokens", "prompt_tokens", "completion_tokens")


def token_breakdown(rows: DataFrame, name_col: str, kind: str | None) -> DataFrame:
    """One model/project row -> four (label, value) rows.

    ``kind`` labels every row; pass None when ``rows`` already has a ``kind``
    column.
    """
    kind_col = F.col("kind") if kind is None else F.lit(kind)
    renamed = rows.select("api_key", kind_col.alias("kind"), F.col(name_col).alias("name"),
                          *[F.col(c).cast("bigint").alias(lbl)
                            for c, lbl in zip(_TOKEN_COLS, TOKEN_LABELS)])
    long = renamed.unpivot(["api_key", "kind", "name"], list(TOKEN_LABELS), "label", "value")
    return long.select("api_key", "kind", "name", "label", "value")


def summary_lines(summary: DataFrame, budget: DataFrame) -> DataFrame:
    """The summary as label/value text rows, plus the budget state line."""
    spend_l, budget_l, remaining_l, usage_l, state_l = SUMMARY_LABELS
    s = summary.select(
        "api_key",
        dollars(F.col("spend")).alias(spend_l),
        dollars(F.col("budget")).alias(budget_l),
        dollars(F.col("remaining")).alias(remaining_l),
        pct(F.col("budget_used_percent")).alias(usage_l),
    )
    b = budget.select("api_key", state_label(F.col("state")).alias(state_l))
    wide = s.join(b, "api_key", "left")
    return wide.unpivot(["api_key"], list(SUMMARY_LABELS), "label", "value") \
        .where(F.col("value").isNotNull())
