"""Plan shape: reports shuffle aggregated rows only; a hot key stays cheap and exact."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from costlens.plans.catalog import registered_queries
from tests.conftest import AS_OF, SF0001, key_row, log_row, make_tables, sha

# Reports whose every shuffle must carry partially aggregated rows.
AGGREGATING = ["admin_key_day_model", "total_spend_month", "summary_week", "by_model_month",
               "by_project_month", "daily_month", "budget_month", "section_counts",
               "alias_month_summary", "alias_by_model", "alias_daily", "admin_cube",
               "admin_pivot", "token_breakdown", "status_text", "model_names", "budget_resolved"]


def _physical(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _exchange_children(plan: str) -> list[str]:
    """First operator below each hash-partitioning Exchange that is not a mere
    Project/Filter (those keep the row count of what they sit on)."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for nxt in lines[i + 1:]:
                d = len(nxt) - len(nxt.lstrip(" :+-"))
                if d > depth:
                    op = nxt.strip(" :+-*()0123456789")
                    if op.startswith(("Project", "Filter")):
                        depth = d
                        continue
                    out.append(op)
                    break
    return out


@pytest.mark.parametrize("name", AGGREGATING)
def test_shuffles_carry_aggregated_rows(spark, name):
    plan = _physical(registered_queries()[name](spark, SF0001))
    children = _exchange_children(plan)
    assert children, plan
    for c in children:
        # every shuffle carries the output of an aggregate (partial or final),
        # never raw log rows
        assert c.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")), \
            (name, c, plan)


def test_share_window_runs_on_aggregated_rows(spark):
    plan = _physical(registered_queries()["by_model_month"](spark, SF0001))
    window_at = plan.index("Window [")
    below = plan[window_at:]
    assert below.index("HashAggregate") < below.index("FileScan")


def test_hot_key_is_exact_and_partially_aggregated(spark):
    hot, cold = sha("sk-hot"), [sha(f"sk-c{i}") for i in range(20)]
    logs = [log_row(hot, f"2024-01-{1 + i % 28:02d} 10:00:00", 0.01, model=f"m{i % 3}")
            for i in range(3000)]
    logs += [log_row(cold[i % 20], f"2024-01-{1 + i % 28:02d} 11:00:00", 0.02, model="m0")
             for i in range(6000)]
    t = make_tables(spark, logs, [key_row(hot, 10.0)] + [key_row(c) for c in cold])
    from costlens.operators import admin, breakdowns, budgets
    tot = {r["api_key"]: r["spend"] for r in breakdowns.total_spend(t, AS_OF, "month").collect()}
    assert tot[hot] == pytest.approx(30.0) and tot[cold[0]] == pytest.approx(6.0)
    b = {r["api_key"]: r["state"] for r in budgets.budget_report(t, AS_OF).collect()}
    assert b[hot] == "exceeded"
    bm = breakdowns.by_model(t, AS_OF, "month").where(F.col("api_key") == hot).collect()
    assert sorted(r["requests"] for r in bm) == [1000, 1000, 1000]
    adm = admin.key_day_model(t, AS_OF)
    assert adm.where(F.col("api_key") == hot).agg(F.sum("requests")).first()[0] == 3000
    plan = _physical(adm)
    assert re.search(r"HashAggregate\(keys=\[api_key.*partial_sum", plan)


def test_no_report_forces_a_broadcast_or_counts_the_key_table(spark):
    from costlens.operators import admin
    t = make_tables(spark, [log_row(sha("sk-1"), "2024-01-05 10:00:00", 1.0)], [key_row(sha("sk-1"))])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        admin.key_day_model(t, AS_OF).explain(extended=True)
    assert "strategy=broadcast" not in buf.getvalue()


@pytest.mark.parametrize("name", ["alias_month_summary", "alias_by_model", "alias_daily"])
def test_alias_reports_pick_their_keys_before_aggregating(spark, name):
    plan = _physical(registered_queries()[name](spark, SF0001))
    partial = plan.index("partial_sum")
    assert "LeftSemi" in plan[partial:], plan          # the semi join lies below the partial aggregate
    assert plan.count("Exchange hashpartitioning") <= 1, plan


def test_reconcile_reads_only_its_days_folders(spark):
    from datetime import date

    from costlens.session import work_dir
    from costlens.sources.layout import read_log_layout, write_log_layout
    from costlens.sources.testdata import load_tables
    from costlens.streaming.reconcile import recompute
    path = work_dir(spark, "t-recon") + "/logs"
    write_log_layout(load_tables(spark, SF0001).logs, path)
    plan = _physical(recompute(read_log_layout(spark, path), date(2024, 1, 5), date(2024, 1, 6)))
    assert re.search(r"PartitionFilters: \[[^]]*day#", plan), plan
