"""Benchmark: headline reports at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no driver collect).
After one warm-up pass over all queries, each runs five times; the median is
reported.  Spark's event log (written to a fresh scratch folder) gives, per
query and run, the shuffle bytes written and the input rows read.  A one-key
weekly by-model report and one key's monthly summary (the reference's one
timed query) also run on the raw log and on the day-partitioned, key-sorted
layout (S5/S6), to show the rows the layout lets Spark skip.

Prints one JSON line: {"metric", "value" (sum of medians), "unit", "queries",
"sf", "shuffle_bytes", "input_rows", "layout", ...}.
"""

from __future__ import annotations

import glob
import json
import os
import re
import statistics
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from costlens.config import FIXED_AS_OF  # noqa: E402
from costlens.operators import breakdowns, budgets  # noqa: E402
from costlens.periods import Period  # noqa: E402
from costlens.plans.catalog import registered_queries  # noqa: E402
from costlens.session import local_session, work_dir  # noqa: E402
from costlens.sources.layout import read_log_layout, write_log_layout  # noqa: E402
from costlens.sources.tables import Tables  # noqa: E402
from costlens.sources.testdata import load_tables  # noqa: E402

HEADLINE = [
    "admin_key_day_model", "summary_month", "by_model_month", "by_project_month", "daily_month",
    "budget_month", "over_budget_keys", "alias_month_summary", "alias_by_model", "key_auth_valid",
    "identity", "admin_cube", "token_breakdown", "status_text", "idempotent_load", "section_counts",
    "alias_daily", "refresh_bundle", "top_spenders", "top_by_model", "team_totals", "spend_in_currencies",
    "anomalies_month", "cost_allocation",
]
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
ONE_KEY = "sk-user-7"


def _event_metrics(log_dir: str) -> dict[str, dict[str, int]]:
    """Per job group: summed shuffle bytes written and input bytes read."""
    files = [f for f in glob.glob(f"{log_dir}/**/*", recursive=True) if os.path.isfile(f)]
    stage_group: dict[int, str] = {}
    out: dict[str, dict[str, int]] = defaultdict(lambda: {"shuffle": 0, "input": 0})
    # "input" counts rows read by scans (Input Metrics / Records Read), key
    # table included; the local-FS byte counter under-reports single-file
    # Parquet reads.
    events = []
    for f in files:
        with open(f) as fh:
            for line in fh:
                if '"SparkListenerJobStart"' in line or '"SparkListenerTaskEnd"' in line:
                    events.append(json.loads(line))
    for e in events:
        if e["Event"] == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id")
            if group:
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = group
    for e in events:
        if e["Event"] == "SparkListenerTaskEnd":
            group = stage_group.get(e.get("Stage ID"))
            m = e.get("Task Metrics") or {}
            if group:
                out[group]["shuffle"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                out[group]["input"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    log_dir = tempfile.mkdtemp(prefix="costlens-bench-events-")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "8")),
                          app="costlens-bench", extra={
                              "spark.eventLog.enabled": "true",
                              "spark.eventLog.dir": log_dir,
                              "spark.eventLog.compress": "false",
                              "spark.eventLog.rolling.enabled": "false"})
    sc = spark.sparkContext
    qs = registered_queries()
    names = [n for n in HEADLINE if n in qs]
    extra = os.environ.get("BENCH_QUERIES")
    if extra:
        names = [n for n in extra.split(",") if n in qs]

    def run(name: str, make=None, group: str | None = None) -> float:
        sc.setJobGroup(group or "warmup", group or "warmup")
        t0 = time.perf_counter()
        (make or (lambda: qs[name](spark, sf_dir)))().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:  # one warm-up pass over all queries (JIT, file listing)
        run(name)
    out: dict[str, float] = {}
    for name in names:
        out[name] = round(statistics.median(run(name, group=name) for _ in range(RUNS)), 4)

    # One key's weekly by-model report, raw log vs day/key layout.
    tables = load_tables(spark, sf_dir)
    layout_path = work_dir(spark, "bench-layout") + "/logs"
    sc.setJobGroup("layout-write", "layout-write")
    write_log_layout(tables.logs, layout_path, num_partitions=124, row_group_bytes=16 << 10)
    laid = Tables(read_log_layout(spark, layout_path), tables.keys)
    layout_times = {}
    cases = [("one_key_week_raw", tables, breakdowns.by_model, Period.WEEK),
             ("one_key_week_layout", laid, breakdowns.by_model, Period.WEEK),
             # the reference's one timed query: one key's monthly summary
             ("one_key_summary_month_raw", tables, budgets.summary, Period.MONTH),
             ("one_key_summary_month_layout", laid, budgets.summary, Period.MONTH)]
    for label, t, fn, period in cases:
        def make(t=t, fn=fn, period=period):
            return fn(breakdowns.one_key(t, ONE_KEY), FIXED_AS_OF, period)
        run(label, make)
        layout_times[label] = round(statistics.median(run(label, make, label) for _ in range(RUNS)), 4)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    metrics = _event_metrics(log_dir)

    def per_run(name: str, kind: str) -> int:
        return int(metrics.get(name, {}).get(kind, 0) / RUNS)

    total = round(sum(out.values()), 4)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": out,
        "sf": float(m.group(1)) if m else sf_dir,
        "log_rows": rows,
        "log_rows_per_sec": {n: round(rows / s, 1) for n, s in out.items() if s},
        "shuffle_bytes": {n: per_run(n, "shuffle") for n in out},
        "input_rows": {n: per_run(n, "input") for n in out},
        "layout": {label: {"sec": sec, "input_rows": per_run(label, "input")}
                   for label, sec in layout_times.items()},
        "runs": RUNS,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
