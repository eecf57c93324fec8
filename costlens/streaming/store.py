"""The serving tables kept current by the stream and the reconcile job.

``rollup``: (day, api_key, raw model) with exact decimal measures, in parts by
day and bucket (a hash of the key).  NULL and empty models are kept so every
report (total, by model with either normaliser, project, daily) derives from it.

``alerts``: budget-state changes per key at each closed UTC day, in parts by
month and bucket.

A publish writes new folders for the parts it changes and then swaps in the
next version of the tables (``costlens.files``).  Nothing that is being read is
written to, so a publish that dies half way changes nothing and can run again;
a micro-batch that is already in the tables is skipped.  Both tables of a
version fit together: readers never see new totals with old alerts or half a day.

Work per micro-batch follows the touched keys: only the buckets that hold them
are read and written, in the touched days (totals) and months (alerts).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.files import ATTEMPTS, folder_of
from costlens.functions.money import percent_of, to_double
from costlens.operators.budgets import budget_state, resolve_budget
from costlens.operators.facts import GRAIN, MEASURE_COLS, ROLLUP_SCHEMA, Rollup
from costlens.session import remove, work_dir
from costlens.streaming import manifest as M

#: Gives the key table as it is now; the stream calls it in every batch.
Keys = Callable[[SparkSession], DataFrame]

ALERT_COLS = ("api_key", "day", "previous_state", "state", "spent_to_date", "budget",
              "used_percent")
ALERT_SCHEMA = ("api_key string, day date, previous_state string, state string, "
                "spent_to_date double, budget double, used_percent double")


@dataclass(frozen=True)
class Store:
    """``buckets`` splits each day and month by key; it cannot change once a table is written."""

    root: str
    buckets: int = 4

    def files(self, spark: SparkSession) -> M.Files:
        return M.Files(spark, self.root)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("api_key"), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, table: str, parts: dict[str, str]) -> DataFrame:
        """The rows of these parts of ``rollup`` or ``alerts``; only their folders are listed."""
        schema = ROLLUP_SCHEMA + ", bucket int" if table == "rollup" else ALERT_SCHEMA + ", month string, bucket int"
        columns = (*GRAIN, *MEASURE_COLS) if table == "rollup" else ALERT_COLS
        if not parts:
            return spark.createDataFrame([], schema).select(*columns)
        at = f"{self.root}/{table}"
        return (spark.read.schema(schema).option("basePath", at)
                .parquet(*sorted(f"{at}/v={folder}/{part}" for part, folder in parts.items())).select(*columns))

    def rollup(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, "rollup", M.latest(self.files(spark)).rollup)

    def alerts(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, "alerts", M.latest(self.files(spark)).alerts)

    def served(self, spark: SparkSession, open_from: date) -> Rollup | None:
        """The rollup for reports, with the days it answers: from the first
        reconciled day on, as far as every day is reconciled and lies before
        ``open_from`` (the watermark's day).  Rows that the stream dropped or
        has not seen are in no other day, so later days are read from the log."""
        now = M.latest(self.files(spark))
        done = sorted(d for d in map(date.fromisoformat, now.days) if d < open_from)
        if not done:
            return None
        last = done[0]
        while last + timedelta(days=1) in done:
            last += timedelta(days=1)
        return Rollup(self.read(spark, "rollup", now.rollup), done[0], last)

    def vacuum(self, spark: SparkSession, keep: int = 20) -> int:
        return M.vacuum(self.files(spark), keep)


def _parts(parts: dict[str, str], first: set[str], buckets: set[int] | None = None) -> dict[str, str]:
    """Those of the parts ``name=../bucket=..`` with one of these days or months, and buckets."""
    out = {}
    for part, folder in parts.items():
        named, bucket = re.fullmatch(r"\w+=([-\d]+)/bucket=(\d+)", part).groups()
        if named in first and (buckets is None or int(bucket) in buckets):
            out[part] = folder
    return out


def _write(spark: SparkSession, store: Store, table: str, rows: DataFrame, by: str, version: int) -> dict[str, str]:
    """Write rows into a folder of their own; the parts that have rows."""
    folder = folder_of(version)
    # REBALANCE lets AQE size the files of a part: few files for a small one,
    # even splits of a large one, no task with a whole hot day.
    (rows.withColumn("bucket", store.bucket()).hint("rebalance", by, "bucket")
     .write.partitionBy(by, "bucket").parquet(f"{store.root}/{table}/v={folder}"))
    files, out = store.files(spark), {}
    for first in files.names(f"{table}/v={folder}"):
        if first.startswith(f"{by}="):
            out |= {f"{first}/{b}": folder for b in files.names(f"{table}/v={folder}/{first}")}
    return out


def day_alerts(rollup: DataFrame, keys: DataFrame, cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """State at the end of each day from month-to-date spend; rows where it changed.

    The first day with spend in a month is compared with ``normal`` (nothing
    spent yet).  Keys without a key row use the default budget (J5).  The
    window runs over one key's days of one month (<= 31 rows), so a hot key
    cannot make a large window partition.
    """
    daily = rollup.groupBy("api_key", "day").agg(F.sum("spend").alias("spend"))
    caps = keys.select(F.col("token").alias("api_key"),
                       resolve_budget(F.col("max_budget"), cfg).alias("budget"))
    j = (daily.join(caps, "api_key", "left")
         .withColumn("budget", F.coalesce(F.col("budget"), F.lit(cfg.default_budget))))
    w = Window.partitionBy("api_key", F.trunc("day", "month")).orderBy("day")
    j = j.withColumn("spent_to_date", to_double(F.sum("spend").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    used = percent_of(F.col("spent_to_date"), F.col("budget"))
    st = j.withColumn("used_percent", used).withColumn("state", budget_state(used, cfg))
    st = st.withColumn("previous_state",
                       F.coalesce(F.lag("state").over(w), F.lit("normal")))
    return st.where(F.col("state") != F.col("previous_state")).select(*ALERT_COLS)


def _with_alerts(spark: SparkSession, store: Store, base: M.Manifest, rollup: dict[str, str], touched: DataFrame,
                 days: set[date], buckets: set[int], keys: DataFrame, cfg: ReportConfig) -> M.Manifest:
    """The next version: the new totals, and the alerts of the touched keys' months recomputed from them.

    ``touched`` holds ``(api_key, month)``, the first day of the month.  Alerts
    of other keys are carried over.
    """
    months = {f"{d:%Y-%m}" for d in days}
    in_months = _parts(rollup, {d for d in (p[4:14] for p in rollup) if d[:7] in months}, buckets)
    month = F.trunc("day", "month")
    here = (store.read(spark, "rollup", in_months).withColumn("month", month)
            .join(touched, ["api_key", "month"], "left_semi").drop("month"))
    old = _parts(base.alerts, months, buckets)
    other = (store.read(spark, "alerts", old).withColumn("month", month)
             .join(touched, ["api_key", "month"], "left_anti").select(*ALERT_COLS))
    alerts = day_alerts(here, keys, cfg).unionByName(other).withColumn("month", F.date_format("day", "yyyy-MM"))
    made = _write(spark, store, "alerts", alerts, "month", base.version + 1)
    kept = {p: f for p, f in base.alerts.items() if p not in old}
    return replace(base, version=base.version + 1, rollup=rollup, alerts=kept | made)


def _commit(spark: SparkSession, store: Store, build: Callable[[M.Manifest], M.Manifest | None]) -> None:
    """Build the next version on the newest one, again if another writer was faster."""
    files = store.files(spark)
    for _ in range(ATTEMPTS):
        made = build(M.latest(files))
        if made is None or M.commit(files, made):
            return
    raise RuntimeError(f"other writers were faster {ATTEMPTS} times: {store.root}")


def _touched(rows: DataFrame) -> DataFrame:
    return rows.select("api_key", F.trunc("day", "month").alias("month")).distinct()


def publish_days(spark: SparkSession, store: Store, rows: DataFrame, days: Iterable[date], keys: DataFrame,
                 cfg: ReportConfig = DEFAULT_CONFIG, complete: bool = False) -> None:
    """Make ``rows`` the whole content of ``days``, with the alerts of their keys.

    A day without rows loses its parts.  ``days`` is a bounded list: those of
    one reconcile.  ``complete`` says that the rows are all there is of them.
    """
    days = set(days)
    if not days:
        return
    rows = rows.where(F.col("day").isin(sorted(days))).select(*GRAIN, *MEASURE_COLS).persist()

    def build(base: M.Manifest) -> M.Manifest:
        old = _parts(base.rollup, set(map(str, days)))
        touched = _touched(store.read(spark, "rollup", old).unionByName(rows))
        kept = {p: f for p, f in base.rollup.items() if p not in old}
        made = kept | _write(spark, store, "rollup", rows, "day", base.version + 1)
        done = sorted({*base.days, *map(str, days)}) if complete else base.days
        return replace(_with_alerts(spark, store, base, made, touched, days, set(range(store.buckets)), keys, cfg), days=done)

    try:
        _commit(spark, store, build)
    finally:
        rows.unpersist()


def publish_groups(spark: SparkSession, store: Store, changed: DataFrame, keys: DataFrame,
                   cfg: ReportConfig = DEFAULT_CONFIG, batch: tuple[str, int] | None = None) -> None:
    """Replace single (day, api_key, model) groups of the rollup by their new totals.

    ``changed`` holds one row per group with the group's whole total so far.
    ``batch`` names the stream and its micro-batch: one that is in the tables
    already is skipped.  Other groups of the touched parts are carried over.

    A micro-batch's own session plans without AQE and ignores REBALANCE, so
    that every state partition would write a file into every part.  The groups
    are written once by it, and the rest is done in ``spark``.
    """
    aside = work_dir(spark, "changed")
    changed.select(*GRAIN, *MEASURE_COLS).write.parquet(aside)
    changed = spark.read.schema(ROLLUP_SCHEMA).parquet(aside)
    try:
        hit = [(r["day"], r["bucket"]) for r in changed.select("day", store.bucket().alias("bucket")).distinct().collect()]
        days, buckets = {d for d, _ in hit}, {b for _, b in hit}
        parts = {f"day={d}/bucket={b}" for d, b in hit}

        def build(base: M.Manifest) -> M.Manifest | None:
            if not hit or batch and base.batches.get(batch[0], -1) >= batch[1]:
                return None
            old = store.read(spark, "rollup", {p: base.rollup[p] for p in parts if p in base.rollup})
            same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in GRAIN]
            kept = old.alias("old").join(changed.alias("new"), same, "left_anti").select(*GRAIN, *MEASURE_COLS)
            made = base.rollup | _write(spark, store, "rollup", kept.unionByName(changed), "day", base.version + 1)
            seen = base.batches | ({batch[0]: batch[1]} if batch else {})
            return replace(_with_alerts(spark, store, base, made, _touched(changed), days, buckets, keys, cfg), batches=seen)

        _commit(spark, store, build)
    finally:
        remove(spark, aside)


def mark_complete(spark: SparkSession, store: Store, days: Iterable[date]) -> None:
    """Say that the rollup holds all there is of these days."""
    named = set(map(str, days))
    _commit(spark, store, lambda base: None if named <= set(base.days) else replace(
        base, version=base.version + 1, days=sorted({*base.days, *named})))


def refresh_alerts(spark: SparkSession, store: Store, keys: DataFrame, cfg: ReportConfig = DEFAULT_CONFIG) -> None:
    """Recompute all alerts, as after a change of caps; publishes do so for the keys they touch."""
    def build(base: M.Manifest) -> M.Manifest:
        rows = store.read(spark, "rollup", base.rollup)
        days = {date.fromisoformat(p[4:14]) for p in base.rollup}
        return _with_alerts(spark, store, replace(base, alerts={}), base.rollup, _touched(rows), days, set(range(store.buckets)), keys, cfg)

    _commit(spark, store, build)
