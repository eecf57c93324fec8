"""Serving tables: atomic publishing, incremental alerts, admission, collapsing of copies."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from costlens.operators.facts import ROLLUP_SCHEMA
from costlens.session import work_dir
from costlens.streaming import manifest as M
from costlens.streaming import rollup as R
from costlens.streaming import store as S
from costlens.streaming.admission import quarantined, readmit
from costlens.streaming.reconcile import reconcile_days, reconcile_mismatched
from costlens.streaming.rollup import collapsed, run_once, stream_measures, watermark_day
from tests.conftest import key_row, log_row, make_tables, rows, sha

KEYS = [sha(f"sk-{i}") for i in range(12)]
DAY = date(2024, 1, 2)


def groups(spark, *made):
    """(day, key, model, spend) -> changed rollup groups."""
    return spark.createDataFrame([(d, k, m, Decimal(str(x)), 1, 1, 1, 0) for d, k, m, x in made], ROLLUP_SCHEMA)


def state(spark, store):
    return rows(store.rollup(spark).select("day", "api_key", "model", F.col("spend").cast("double")))


@pytest.fixture
def keys(spark):
    return make_tables(spark, [], [key_row(k, 10.0) for k in KEYS]).keys


@pytest.mark.parametrize("dies", ["commit", "_with_alerts", "_write"])
def test_a_batch_that_died_runs_again_and_keeps_every_group(spark, keys, monkeypatch, dies):
    store = S.Store(work_dir(spark, "t-crash") + "/store", buckets=2)
    first = [(DAY, k, "m", 2.0) for k in KEYS]
    S.publish_groups(spark, store, groups(spark, *first), keys, batch=("s", 0))
    second = groups(spark, (DAY, KEYS[0], "m", 30.0), (DAY, KEYS[0], "n", 1.0))
    real = getattr(M if dies == "commit" else S, dies)
    with monkeypatch.context() as m:
        def dead(*a, **b):
            if dies == "_write":
                real(*a, **b)
            raise RuntimeError("lost")
        m.setattr(M if dies == "commit" else S, dies, dead)
        with pytest.raises(RuntimeError, match="lost"):
            S.publish_groups(spark, store, second, keys, batch=("s", 1))
    assert state(spark, store) == sorted(((d, k, m, x) for d, k, m, x in first), key=repr)   # the old version, whole
    assert store.alerts(spark).count() == 0
    S.publish_groups(spark, store, second, keys, batch=("s", 1))
    want = [(DAY, k, "m", 2.0) for k in KEYS[1:]] + [(DAY, KEYS[0], "m", 30.0), (DAY, KEYS[0], "n", 1.0)]
    assert state(spark, store) == sorted(want, key=repr)
    assert rows(store.alerts(spark), "api_key", "state") == [(KEYS[0], "exceeded")]
    S.publish_groups(spark, store, groups(spark, (DAY, KEYS[1], "m", 99.0)), keys, batch=("s", 1))   # published already
    assert state(spark, store) == sorted(want, key=repr)


def test_readers_keep_their_version_and_vacuum_drops_old_ones(spark, keys):
    store = S.Store(work_dir(spark, "t-snap") + "/store", buckets=2)
    S.publish_groups(spark, store, groups(spark, *[(DAY, k, "m", 1.0) for k in KEYS]), keys)
    held = store.rollup(spark)
    for x in (2.0, 3.0):
        S.publish_groups(spark, store, groups(spark, *[(DAY, k, "m", x) for k in KEYS]), keys)
    assert {r[0] for r in held.select(F.col("spend").cast("double")).collect()} == {1.0}
    files = store.files(spark)
    S._write(spark, store, "rollup", groups(spark, (DAY, KEYS[0], "m", 7.0)), "day", 4)      # a writer at work
    assert M.versions(files) == [1, 2, 3] and store.vacuum(spark, keep=1) >= 2
    assert M.versions(files) == [3] and len(files.names("rollup")) == 2
    assert {x[3] for x in state(spark, store)} == {3.0} and store.vacuum(spark, keep=1) == 0


def test_of_two_writers_one_starts_over(spark, keys, monkeypatch):
    store = S.Store(work_dir(spark, "t-two") + "/store", buckets=1)
    real, other = M.commit, [True]

    def slow(files, made):
        if other.pop() if other else False:
            S.publish_groups(spark, store, groups(spark, (DAY, KEYS[1], "m", 5.0)), keys, batch=("b", 0))
        return real(files, made)

    monkeypatch.setattr(M, "commit", slow)
    S.publish_groups(spark, store, groups(spark, (DAY, KEYS[0], "m", 4.0)), keys, batch=("a", 0))
    assert state(spark, store) == sorted([(DAY, KEYS[0], "m", 4.0), (DAY, KEYS[1], "m", 5.0)], key=repr)
    assert M.latest(store.files(spark)).batches == {"a": 0, "b": 0}


def test_alerts_follow_touched_keys_and_equal_the_whole_computation(spark, keys):
    rng = random.Random(8)
    store, now = S.Store(work_dir(spark, "t-inc") + "/store", buckets=4), {}
    for batch in range(4):
        changed = {}
        for _ in range(14):
            d = date(2024, 1, 20) + timedelta(days=rng.randint(0, 20))
            changed[(d, rng.choice(KEYS), rng.choice(["m", "n", None]))] = round(rng.uniform(0, 6), 2)
        now |= changed
        S.publish_groups(spark, store, groups(spark, *[(*g, x) for g, x in changed.items()]), keys, batch=("s", batch))
        whole = S.day_alerts(groups(spark, *[(*g, x) for g, x in now.items()]), keys)
        assert rows(store.alerts(spark)) == rows(whole) and whole.count() > 1
    before = M.latest(store.files(spark))
    S.publish_groups(spark, store, groups(spark, (date(2024, 2, 1), KEYS[3], "m", 50.0)), keys, batch=("s", 9))
    after = M.latest(store.files(spark))
    assert len({p for p in after.rollup if before.rollup.get(p) != after.rollup[p]}) == 1
    assert len({p for p in after.alerts if before.alerts.get(p) != after.alerts[p]}) == 1
    richer = make_tables(spark, [], [key_row(k, 1000.0) for k in KEYS]).keys
    S.refresh_alerts(spark, store, richer)
    assert store.alerts(spark).count() == 0 and rows(store.rollup(spark)) == rows(store.read(spark, "rollup", after.rollup))


def test_a_row_dated_ahead_is_set_aside_and_the_next_day_counts(spark):
    work = work_dir(spark, "t-ahead")
    store, landing, ckpt = S.Store(f"{work}/store"), f"{work}/landing", f"{work}/ckpt"
    first = [log_row(KEYS[0], "2024-01-01 10:00:00", 1.0), log_row(KEYS[0], "2031-05-01 10:00:00", 2.0, request_id="ahead")]
    second = [log_row(KEYS[0], f"2024-01-02 10:{i:02d}:00", 1.0) for i in range(39)]
    t = make_tables(spark, first + second, [key_row(KEYS[0], 1000.0)])
    for batch in (first, second):
        make_tables(spark, batch, []).logs.write.mode("append").parquet(landing)
        progress = run_once(spark, landing, store, ckpt, lambda s: t.keys)
    assert rows(store.rollup(spark), "day", "requests") == [(date(2024, 1, 1), 1), (date(2024, 1, 2), 39)]
    assert rows(quarantined(spark, store.root), "request_id", "spend") == [("ahead", 2.0)]
    assert store.served(spark, watermark_day(progress)) is None          # nothing is reconciled yet
    reconcile_days(spark, store, t.logs, t.keys, date(2024, 1, 1), date(2024, 1, 1))
    assert store.served(spark, date(2024, 1, 9)).last_day == date(2024, 1, 1)
    assert reconcile_mismatched(spark, store, t.logs, t.keys, date(2024, 1, 1), date(2024, 1, 2)) == 0
    assert store.served(spark, date(2024, 1, 9)).last_day == date(2024, 1, 2)
    readmit(spark, store.root, landing, datetime(2026, 1, 1))             # not due
    assert quarantined(spark, store.root).count() == 1
    readmit(spark, store.root, landing, datetime(2031, 5, 1, 9, 30))      # due within the tolerance
    assert quarantined(spark, store.root).count() == 0
    run_once(spark, landing, store, ckpt, lambda s: t.keys, clock=datetime(2031, 5, 1, 9, 30))
    assert rows(store.rollup(spark), "day", "requests")[-1] == (date(2031, 5, 1), 1)


def test_a_wrong_clock_can_be_corrected(spark):
    work = work_dir(spark, "t-clock")
    store, landing, ckpt = S.Store(f"{work}/store"), f"{work}/landing", f"{work}/ckpt"
    made = make_tables(spark, [log_row(KEYS[0], "2031-05-01 10:00:00", 2.0, request_id="ahead")], [key_row(KEYS[0])])
    made.logs.write.parquet(landing)
    run_once(spark, landing, store, ckpt, lambda s: made.keys)
    for _ in range(2):      # again after a loss: nothing is left to land
        readmit(spark, store.root, landing, datetime(2024, 1, 3), at=F.lit("2024-01-03 08:00:00").cast("timestamp_ntz"))
    run_once(spark, landing, store, ckpt, lambda s: made.keys)
    assert rows(store.rollup(spark), "day", "requests") == [(date(2024, 1, 3), 1)]
    assert quarantined(spark, store.root).count() == 0


def test_a_storm_of_one_id_reaches_the_state_as_a_row_per_task(spark):
    storm = [log_row(KEYS[0], "2024-01-02 10:00:00", 1.0, request_id="storm")] * 500
    other = [log_row(KEYS[1], "2024-01-02 11:00:00", 1.0) for _ in range(60)]
    mixed = [x for i in range(500) for x in ([storm[i], other[i % 60]] if i < 60 else [storm[i]])]
    t = make_tables(spark, mixed, [key_row(KEYS[0]), key_row(KEYS[1])])
    measures = stream_measures(t.logs).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        sent = collapsed(measures).groupBy("request_id").count()
        assert sent.where("request_id = 'storm'").first()["count"] <= 7 and sent.count() == 61
        small = collapsed(measures, remembered=0).groupBy("request_id").count()
        assert small.where("request_id = 'storm'").first()["count"] < 60 and small.count() == 61
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    work = work_dir(spark, "t-storm")
    store = S.Store(f"{work}/store")
    t.logs.repartition(5).write.parquet(f"{work}/landing")
    for _ in range(2):
        run_once(spark, f"{work}/landing", store, f"{work}/ckpt", lambda s: t.keys)
        t.logs.limit(200).write.mode("append").parquet(f"{work}/landing")
    assert rows(store.rollup(spark), "api_key", "requests") == sorted([(KEYS[0], 1), (KEYS[1], 60)])


def test_the_latest_copy_passes_so_that_a_late_one_cannot_hide_it(spark):
    copies = [log_row(KEYS[0], ts, 1.0, request_id="x") for ts in ("2024-01-01 10:00:00", "2024-01-09 10:00:00", "2024-01-05 10:00:00")]
    out = collapsed(stream_measures(make_tables(spark, copies, []).logs.coalesce(1)))
    assert [r["event_time"].day for r in out.collect()] == [9]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        one = make_tables(spark, [copies[0]] * 3 + copies, []).logs.coalesce(1)
        assert sorted(r["event_time"].day for r in collapsed(stream_measures(one)).collect())[-1] == 9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert collapsed(stream_measures(make_tables(spark, copies, []).logs.limit(0))).count() == 0


def test_a_batch_of_many_state_partitions_writes_one_file_into_a_part(spark):
    work = work_dir(spark, "t-parts")
    store = S.Store(f"{work}/store", buckets=2)
    made = [log_row(k, f"2024-01-0{d} 10:00:00", 20.0) for d in (2, 3) for k in KEYS for _ in range(3)]
    t = make_tables(spark, made, [key_row(k, 50.0) for k in KEYS])
    t.logs.write.parquet(f"{work}/landing")
    run_once(spark, f"{work}/landing", store, f"{work}/ckpt", lambda s: t.keys, state_partitions=6)
    assert {x[2] for x in rows(store.rollup(spark), "day", "api_key", "requests")} == {3}
    assert store.rollup(spark).count() == 24 and store.alerts(spark).count() == 12
    now, files = M.latest(store.files(spark)), store.files(spark)
    for table, parts in (("rollup", now.rollup), ("alerts", now.alerts)):
        assert parts and all(len([n for n in files.names(f"{table}/v={folder}/{part}") if n.startswith("part-")]) == 1
                             for part, folder in parts.items())


def test_state_partitions_follow_the_landed_rows_and_not_the_shuffle(spark, monkeypatch):
    work = work_dir(spark, "t-size")
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "200")
    t = make_tables(spark, [log_row(KEYS[0], "2024-01-02 10:00:00", 1.0)], [key_row(KEYS[0])])
    least = max(R.STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    assert R.state_size(wide, f"{work}/landing", f"{work}/ckpt") == least          # nothing has landed
    t.logs.write.parquet(f"{work}/landing")
    run_once(wide, f"{work}/landing", S.Store(f"{work}/store"), f"{work}/ckpt", lambda s: t.keys)
    stores = [n for n in S.M.Files(spark, f"{work}/ckpt/state").names("0") if n.isdigit()]
    assert len(stores) == least
    assert R.state_size(wide, f"{work}/landing", f"{work}/ckpt") is None           # the checkpoint has it
    monkeypatch.setattr(R, "STATE_BYTES", 10)
    assert R.state_size(wide, f"{work}/landing", f"{work}/new") == 200
