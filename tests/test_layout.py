"""Partition pruning by day and key skipping from Parquet statistics."""

import glob
import io
import contextlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from costlens.operators import breakdowns, budgets
from costlens.session import work_dir
from costlens.sources.layout import read_log_layout, write_log_layout
from costlens.sources.tables import Tables
from costlens.sources.testdata import load_tables
from tests.conftest import AS_OF, SF001, rows


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_layout_prunes_days_and_skips_keys(spark):
    t = load_tables(spark, SF001)
    path = work_dir(spark, "t-layout") + "/logs"
    write_log_layout(t.logs, path, num_partitions=240)
    laid = Tables(read_log_layout(spark, path), t.keys)

    # same answers as on the raw log
    for fn in (breakdowns.by_model, breakdowns.daily):
        assert rows(fn(laid, AS_OF, "week")) == rows(fn(t, AS_OF, "week"))
    assert rows(budgets.budget_report(laid, AS_OF)) == rows(budgets.budget_report(t, AS_OF))

    # The week's day range reaches the scan as a partition filter
    one = breakdowns.one_key(laid, "sk-user-7")
    plan = _plan(breakdowns.by_model(one, AS_OF, "week"))
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-15" in plan
    # The key equality is pushed to Parquet ...
    assert "EqualTo(api_key," in plan

    # ... and the per-file api_key ranges are narrow: one key's rows of a day
    # sit in few of that day's files, so min/max statistics skip the rest.
    key = one.logs.select("api_key").first()[0]
    local = path[len("file:"):] if path.startswith("file:") else path
    day_files = glob.glob(f"{local}/day=2024-01-16/*.parquet")
    assert len(day_files) > 1
    hits = 0
    for f in day_files:
        md = pq.ParquetFile(f).metadata
        idx = md.schema.names.index("api_key")
        for g in range(md.num_row_groups):
            st = md.row_group(g).column(idx).statistics
            if st.min <= key <= st.max:
                hits += 1
    assert hits <= 2 < len(day_files)


def _scanned(df) -> int:
    """Rows that the file scans of ``df`` returned when it ran."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name.startswith("Scan parquet"):
                total += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_one_key_month_reads_far_fewer_rows_than_the_log(spark):
    from costlens.operators import breakdowns
    from costlens.session import work_dir
    from costlens.sources.layout import read_log_layout, write_log_layout
    from tests.conftest import key_row, log_row, make_tables, sha
    logs = [log_row(sha(f"sk-{k}"), f"2024-01-{1 + i % 28:02d} 10:00:00", 0.5) for k in range(60) for i in range(56)]
    t = make_tables(spark, logs, [key_row(sha("sk-7"))])
    path = work_dir(spark, "t-skip") + "/logs"
    write_log_layout(t.logs, path, num_partitions=140, row_group_bytes=4096)
    laid = read_log_layout(spark, path)
    one = laid.where(laid["api_key"] == sha("sk-7")).groupBy("api_key").count()
    assert one.first()["count"] == 56
    assert _scanned(laid.groupBy("api_key").count()) == len(logs)
    assert _scanned(one) < len(logs) / 2
