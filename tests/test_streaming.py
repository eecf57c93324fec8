"""Stream = batch, late rows, duplicates, time-zone independence, refresh bundle."""

from datetime import date, datetime

from pyspark.sql import functions as F

from costlens.functions.time import event_instant, instant_utc_day
from costlens.operators import budgets
from costlens.operators.facts import ROLLUP_SCHEMA, Rollup, daily_rollup
from costlens.periods import TimeRange
from costlens.session import work_dir
from costlens.sources.tables import Tables
from costlens.sources.testdata import load_tables
from costlens.streaming import bundle
from costlens.streaming.feed import land, replay
from costlens.streaming.reconcile import mismatched_days, reconcile_days, reconcile_mismatched
from costlens.streaming.rollup import ROCKSDB, run_once, stream_session, watermark_day
from costlens.streaming.store import Store
from tests.conftest import AS_OF, SF0001, key_row, log_row, make_tables, rows, sha

K1, K2 = sha("sk-a"), sha("sk-b")
ALL = TimeRange(datetime(2000, 1, 1), datetime(2100, 1, 1))


def _cmp(df):
    return rows(df.select("day", "api_key", "model", F.col("spend").cast("double").alias("spend"),
                          "requests", "tokens", "prompt_tokens", "completion_tokens"))


def test_stream_equals_batch_with_days_still_open(spark):
    t = load_tables(spark, SF0001)
    work = work_dir(spark, "t-stream")
    store = Store(f"{work}/store")
    lo, hi, progress = replay(spark, t.logs, lambda s: load_tables(s, SF0001).keys, store, work, chunk_days=10)
    wm = watermark_day(progress)
    assert wm is not None and lo < wm <= hi            # some days are open, and served all the same
    assert _cmp(store.rollup(spark)) == _cmp(daily_rollup(t.logs, ALL))


def test_stream_state_is_in_rocksdb_and_settings_stay(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    own = stream_session(spark)
    assert own.conf.get("spark.sql.streaming.stateStore.providerClass") == ROCKSDB
    assert own.conf.get("spark.sql.shuffle.partitions") == before == spark.conf.get("spark.sql.shuffle.partitions")
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_late_rows_dropped_then_reconciled_and_duplicates_counted_once(spark):
    keys = [key_row(K1, 10.0), key_row(K2, 100.0)]
    first = [log_row(K1, "2024-01-01 10:00:00", 1.0, request_id="a1"),
             log_row(K1, "2024-01-02 10:00:00", 2.0, request_id="a2"),
             log_row(K2, "2024-01-03 10:00:00", 4.0, request_id="b1")]
    second = [log_row(K1, "2024-01-05 10:00:00", 8.0, request_id="a3"),
              log_row(K1, "2024-01-01 12:00:00", 16.0, request_id="late"),  # behind the watermark
              log_row(K2, "2024-01-05 10:00:00", 4.0, request_id="b2"),
              log_row(K2, "2024-01-05 10:00:00", 4.0, request_id="b2")]     # replayed copy
    third = [log_row(K1, "2024-01-09 10:00:00", 1.0, request_id="a4")]
    work = work_dir(spark, "t-late")
    store, landing, ckpt = Store(f"{work}/store"), f"{work}/landing", f"{work}/ckpt"
    tk = make_tables(spark, first + second + third, keys)
    for batch in (first, second, third):
        make_tables(spark, batch, keys).logs.write.mode("append").parquet(landing)
        progress = run_once(spark, landing, store, ckpt, lambda s: tk.keys, "1 day")
    got = {(r["day"], r["api_key"]): (float(r["spend"]), r["requests"])
           for r in store.rollup(spark).collect()}
    assert got[(date(2024, 1, 1), K1)] == (1.0, 1)          # the late row was dropped
    assert got[(date(2024, 1, 5), K2)] == (4.0, 1)          # the copy was dropped
    assert watermark_day(progress) == date(2024, 1, 8)
    bad = rows(mismatched_days(spark, store, tk.logs, date(2024, 1, 1), date(2024, 1, 7)))
    assert bad == [(date(2024, 1, 1),)]
    assert reconcile_mismatched(spark, store, tk.logs, tk.keys, date(2024, 1, 1), date(2024, 1, 7)) == 1
    got = {(r["day"], r["api_key"]): (float(r["spend"]), r["requests"])
           for r in store.rollup(spark).collect()}
    assert got[(date(2024, 1, 1), K1)] == (17.0, 2)
    assert got[(date(2024, 1, 9), K1)] == (1.0, 1)
    # alerts: K1 (cap 10) crosses into exceeded on Jan 1 after the repair, K2 never
    alerts = rows(store.alerts(spark), "api_key", "day", "previous_state", "state")
    assert alerts == [(K1, date(2024, 1, 1), "normal", "exceeded")]


def test_event_time_is_session_zone_free(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0, 5),), (datetime(2024, 1, 1, 23, 59, 59),)],
                               "ts timestamp_ntz")
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [r[0] for r in df.select(instant_utc_day(event_instant(F.col("ts")))).collect()]
            assert got == [date(2024, 1, 1), date(2024, 1, 1)], tz
            w = df.select(F.window(event_instant(F.col("ts")), "1 day").alias("w")) \
                .select(instant_utc_day(F.col("w.start"))).collect()
            assert [r[0] for r in w] == [date(2024, 1, 1)] * 2, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_refresh_bundle_matches_direct_reports(spark):
    t = load_tables(spark, SF0001)
    status = {r["report"]: r for r in bundle.refresh(spark, t, AS_OF, "week",
                                                     work_dir(spark, "t-bundle")).collect()}
    assert all(r["ok"] for r in status.values()) and len(status) == 5
    assert status["budget"]["rows"] == budgets.budget_report(t, AS_OF).count()
    # reports served from the rollup equal reports from the raw log
    rng = bundle.shared_range(AS_OF, "week")
    roll = Rollup(daily_rollup(t.logs, rng), rng.first_day, rng.last_day)
    direct = budgets.summary(t, AS_OF, "week").collect()
    via = budgets.summary(t, AS_OF, "week", rollup=roll).collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, via))


def test_land_copies_whole_days(spark):
    t = load_tables(spark, SF0001)
    work = work_dir(spark, "t-land")
    land(t.logs, f"{work}/l", date(2024, 1, 3), date(2024, 1, 4))
    n = spark.read.parquet(f"{work}/l").count()
    assert n == t.logs.where(F.to_date("startTime").between(F.lit(date(2024, 1, 3)),
                                                             F.lit(date(2024, 1, 4)))).count()


def test_long_running_query_serves_open_days_and_reads_keys_anew(spark):
    from costlens.schemas import VIRTUAL_KEYS_SCHEMA
    from costlens.streaming.rollup import start
    work = work_dir(spark, "t-start")
    store, landing, stored = Store(f"{work}/store"), f"{work}/landing", f"{work}/keys"

    def put(logs, keys):
        t = make_tables(spark, logs, keys)
        t.keys.coalesce(1).write.mode("append").parquet(stored)
        t.logs.coalesce(1).write.mode("append").parquet(landing)

    put([log_row(K1, "2024-01-01 10:00:00", 1.0, request_id="x1")], [key_row(K1, 100.0)])
    q = start(spark, landing, store, f"{work}/ckpt", lambda s: s.read.schema(VIRTUAL_KEYS_SCHEMA).parquet(stored),
              "1 day", every="1 second", state_partitions=2)
    try:
        q.processAllAvailable()
        assert rows(store.rollup(spark), "day", "requests") == [(date(2024, 1, 1), 1)]     # the day is open
        # a key added while the query runs: 5.0 spent of its cap of 5, not of the default budget
        put([log_row(K2, "2024-01-01 11:00:00", 5.0, request_id="x2")], [key_row(K2, 5.0)])
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(store.alerts(spark), "api_key", "state", "budget") == [(K2, "exceeded", 5.0)]


def test_republishing_a_day_replaces_its_alerts(spark):
    from costlens.streaming.store import publish_days
    keys = make_tables(spark, [], [key_row(K1, 10.0)]).keys
    store = Store(work_dir(spark, "t-repub") + "/store")

    def day_rows(spend):
        return spark.createDataFrame([(date(2024, 1, 2), K1, "m", spend, 1, 1, 1, 0)],
                                     ROLLUP_SCHEMA.replace("decimal(38,18)", "double")) \
            .withColumn("spend", F.col("spend").cast("decimal(38,18)"))

    publish_days(spark, store, day_rows(12.0), [date(2024, 1, 2)], keys)
    assert rows(store.alerts(spark), "api_key", "state") == [(K1, "exceeded")]
    publish_days(spark, store, day_rows(1.0), [date(2024, 1, 2)], keys)       # a repair lowered the spend
    assert store.alerts(spark).count() == 0
    assert rows(store.rollup(spark).select(F.col("spend").cast("double"))) == [(1.0,)]


def test_stream_equals_batch_in_a_non_utc_session(spark):
    la = spark.newSession()
    la.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    t = load_tables(la, SF0001)
    work = work_dir(la, "t-stream-tz")
    store = Store(f"{work}/store")
    replay(la, t.logs, lambda s: load_tables(s, SF0001).keys, store, work, chunk_days=15)
    assert _cmp(store.rollup(la)) == _cmp(daily_rollup(load_tables(spark, SF0001).logs, ALL))


def _logs(spark, *made):
    return make_tables(spark, [log_row(K1, ts, spend, request_id=i) for i, ts, spend in made], [key_row(K1, 10.0)])


def _state(spark, store):
    return {r["day"].day: (float(r["spend"]), r["requests"]) for r in store.rollup(spark).collect()}


def test_reconcile_clears_a_vanished_day(spark):
    store = Store(work_dir(spark, "t-vanish") + "/store")
    both = _logs(spark, ("a", "2024-01-02 10:00:00", 12.0), ("b", "2024-01-03 10:00:00", 1.0))
    reconcile_days(spark, store, both.logs, both.keys, date(2024, 1, 1), date(2024, 1, 5))
    assert _state(spark, store) == {2: (12.0, 1), 3: (1.0, 1)} and store.alerts(spark).count() == 1
    one = _logs(spark, ("b", "2024-01-03 10:00:00", 1.0))
    assert reconcile_mismatched(spark, store, one.logs, one.keys, date(2024, 1, 1), date(2024, 1, 5)) == 1
    assert _state(spark, store) == {3: (1.0, 1)} and store.alerts(spark).count() == 0
    assert reconcile_mismatched(spark, store, one.logs, one.keys, date(2024, 1, 1), date(2024, 1, 5)) == 0


def test_reconcile_counts_a_request_on_two_days_once_in_any_split(spark):
    t = _logs(spark, ("a", "2024-01-02 23:00:00", 1.0), ("a", "2024-01-03 01:00:00", 1.0), ("b", "2024-01-03 10:00:00", 4.0))
    together, single = (Store(work_dir(spark, f"t-split{i}") + "/store") for i in range(2))
    reconcile_days(spark, together, t.logs, t.keys, date(2024, 1, 1), date(2024, 1, 4))
    for d in (3, 2, 4, 1):
        reconcile_days(spark, single, t.logs, t.keys, date(2024, 1, d), date(2024, 1, d))
    assert _state(spark, together) == _state(spark, single) == {2: (1.0, 1), 3: (4.0, 1)}


def test_reconcile_repairs_another_spend_of_the_same_count(spark):
    store = Store(work_dir(spark, "t-spend") + "/store")
    old, new = _logs(spark, ("a", "2024-01-02 10:00:00", 1.0)), _logs(spark, ("a", "2024-01-02 10:00:00", 7.0))
    reconcile_days(spark, store, old.logs, old.keys, date(2024, 1, 2), date(2024, 1, 2))
    assert reconcile_mismatched(spark, store, new.logs, new.keys, date(2024, 1, 1), date(2024, 1, 5)) == 1
    assert _state(spark, store) == {2: (7.0, 1)}


def test_reports_read_days_that_the_rollup_lacks_from_the_log(spark):
    t = _logs(spark, ("a", "2024-01-02 10:00:00", 9.0), ("b", "2024-01-05 10:00:00", 5.0))
    store = Store(work_dir(spark, "t-cover") + "/store")
    reconcile_days(spark, store, t.logs, t.keys, date(2024, 1, 2), date(2024, 1, 2))
    roll = store.served(spark, date(2024, 1, 3))
    assert (roll.first_day, roll.last_day) == (date(2024, 1, 2), date(2024, 1, 2))
    got = budgets.budget_report(t, AS_OF, rollup=roll).first()
    assert (got["spent"], got["state"]) == (14.0, "exceeded")
    assert store.served(spark, date(2024, 1, 2)) is None


def test_one_failing_report_leaves_the_others(spark):
    t = load_tables(spark, SF0001)
    broken = Tables(t.logs, t.keys.drop("max_budget"))
    got = {r["report"]: r for r in bundle.refresh(spark, broken, AS_OF, "week", work_dir(spark, "t-broken")).collect()}
    assert {n for n, r in got.items() if r["ok"]} == {"by_model", "by_project", "daily"}
    assert "max_budget" in got["budget"]["error"] and got["budget"]["rows"] is None
