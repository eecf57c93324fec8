"""Anomalies, top spenders, cost allocation and currencies against plain versions."""

import random
from collections import defaultdict
from datetime import date, datetime
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from costlens.operators import allocation, anomalies, budgets, currencies, forecast, top
from costlens.periods import day_range, parse_period, valid_period
from costlens.session import work_dir
from costlens.sources.sinks import read_csv, write_csv
from costlens.sources.tables import Tables
from tests.conftest import AS_OF, key_row, log_row, make_tables, rows, sha
from tests.test_layout import _plan

K = [sha(f"sk-{i}") for i in range(9)]


def test_a_planted_spike_and_a_drop_are_found_and_gaps_count_as_zero(spark):
    logs = [log_row(K[0], f"2024-01-{d:02d} 10:00:00", 10 + d % 3) for d in range(2, 31)]
    logs += [log_row(K[0], "2024-01-20 11:00:00", 300.0), log_row(K[1], "2024-01-01 10:00:00", 5.0), log_row(K[1], "2024-01-31 10:00:00", 9.0)]
    out = anomalies.anomalies(make_tables(spark, logs, []), AS_OF)
    got = {(r["api_key"], r["day"].day): (r["direction"], r["spend"]) for r in out.collect()}
    assert got == {(K[0], 20): ("spike", 312.0), (K[0], 31): ("drop", 0.0), (K[1], 31): ("spike", 9.0)}


@pytest.mark.parametrize("by", [["api_key"], ["model"], ["api_key", "model"]])
def test_anomalies_match_a_plain_version(spark, by):
    rng = random.Random(len(by))
    logs = [log_row(rng.choice(K[:3]), f"2024-01-{rng.randint(1, 31):02d} 10:00:00", round(rng.choice([1, 1, 1, 30]) * rng.uniform(1, 9), 2),
                    model=rng.choice(["m", None])) for _ in range(250)]
    sums = defaultdict(Decimal)
    for r in logs:
        sums[tuple(r[c] for c in by), r["startTime"].day] += Decimal(str(r["spend"]))
    want = []
    for g in {g for g, _ in sums}:
        first = min(d for h, d in sums if h == g)
        series = [float(sums.get((g, d), 0)) for d in range(first, 32)]
        for i in range(7, len(series)):
            mid = median(series[i - 7:i])
            spread = max(1.4826 * median(abs(x - mid) for x in series[i - 7:i]), 0.1 * mid, 1.0)
            if abs(series[i] - mid) / spread >= 4:
                want.append((*g, date(2024, 1, first + i), series[i], mid))
    got = rows(anomalies.anomalies(make_tables(spark, logs, []), AS_OF, by=by), *by, "day", "spend", "expected")
    assert got == sorted(want, key=repr) and want


def test_window_must_be_odd(spark):
    with pytest.raises(ValueError):
        anomalies.anomalies(make_tables(spark, [], []), AS_OF, window=4)


def test_top_spenders_ties_and_plan(spark):
    logs = [log_row(k, "2024-01-05 10:00:00", x, model=m) for k, x, m in
            [(K[0], 5, "a"), (K[1], 7, "a"), (K[2], 7, "b"), (K[3], 7, "a"), (K[4], 0, "a"), (K[5], 1, "")]]
    t = make_tables(spark, logs, [key_row(K[1], alias="one")])
    first, second, third = sorted([K[1], K[2], K[3]])
    out = top.top_spenders(t, AS_OF, k=4)
    assert [tuple(r)[:2] for r in out.orderBy("rank").collect()] == [(1, first), (2, second), (3, third), (4, K[0])]
    assert {r["api_key"]: r["key_alias"] for r in out.collect()}[K[1]] == "one"
    assert top.top_spenders(t, AS_OF, k=99).count() == 5                 # no spend, no rank
    by = rows(top.top_by_model(t, AS_OF, k=2), "model", "rank", "api_key")
    assert by == sorted([("a", 1, min(K[1], K[3])), ("a", 2, max(K[1], K[3])), ("b", 1, K[2])])
    assert "TakeOrderedAndProject" in _plan(out)
    limit = _plan(top.top_by_model(t, AS_OF))
    assert "WindowGroupLimit" in limit and "Partial" in limit            # tasks send on k rows of a group


def test_positions_in_groups_of_any_size(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "b", "c"]), rng.randint(0, 5), f"n{i}") for i in range(900)] + [("one", 1, "x")]
    df = spark.createDataFrame(data, "g string, x int, n string").repartition(4)
    out = allocation.positions(df, ["g"], [F.desc("x"), F.col("n")], work_dir(spark, "t-pos"))
    want = []
    for g in {g for g, _, _ in data}:
        want += [(g, x, n, i) for i, (x, n) in enumerate(sorted(((x, n) for h, x, n in data if h == g), key=lambda r: (-r[0], r[1])), 1)]
    assert rows(out, "g", "x", "n", "position") == sorted(want, key=repr)


def largest_remainder(whole, weights):
    total = sum(weights.values())
    if not total:
        weights, total = dict.fromkeys(weights, 1), len(weights)
    base = {n: whole * w // total for n, w in weights.items()}
    order = sorted(weights, key=lambda n: (-(whole * weights[n] % total), n))
    for n in order[:whole - sum(base.values())]:
        base[n] += 1
    return base


@pytest.mark.parametrize("whole", [0, 1, 100, 10**12 + 7])
def test_apportioning_matches_a_plain_version(spark, whole):
    rng = random.Random(whole)
    parts = [(g, f"p{i}", rng.choice([0, 1, 1, 7, 10**15])) for g in ("a", "b") for i in range(40)] + [("zero", f"p{i}", 0) for i in range(3)]
    out = allocation.apportioned(spark.createDataFrame(parts, "g string, name string, weight long").withColumn("weight", F.col("weight").cast("decimal(38,0)")),
                                 spark.createDataFrame([(g, whole) for g in ("a", "b", "zero")], "g string, amount long"), ["g"], "name", work_dir(spark, "t-app"))
    want = [(g, n, a) for g in ("a", "b", "zero") for n, a in largest_remainder(whole, {n: w for h, n, w in parts if h == g}).items()]
    assert rows(out, "g", "name", "amount") == sorted(want, key=repr)


def test_allocation_adds_up_at_every_level(spark):
    rng = random.Random(4)
    logs = [log_row(rng.choice(K), "2024-01-05 10:00:00", rng.choice([0.0, 0.013, 1 / 3, 19.99])) for _ in range(120)]
    keys = [key_row(k, user_id=f"u{i % 4}" if i % 3 else None) for i, k in enumerate(K[:7])]
    t = make_tables(spark, logs, keys)
    t = Tables(t.logs, t.keys.withColumn("team_id", F.when(F.col("user_id").isin("u1", "u2"), F.lit("red")).otherwise(F.lit(""))))
    for amount in (None, Decimal("1234.56")):
        out = allocation.cost_allocation(t, AS_OF, "month", work_dir(spark, "t-alloc"), amount).collect()
        total = amount if amount is not None else sum((Decimal(repr(r["spend"])) for r in logs), Decimal(0)).quantize(Decimal("0.01"))
        assert sum(r["allocated"] for r in out) == total
        users, teams = defaultdict(Decimal), defaultdict(Decimal)
        for r in out:
            users[r["team"], r["user"], r["user_allocated"]] += r["allocated"]
            teams[r["team"], r["team_allocated"]] += r["allocated"]
        assert all(k[2] == v for k, v in users.items()) and all(k[1] == v for k, v in teams.items()) and len(teams) == 2
    totals = allocation.team_totals(t, AS_OF)
    assert sum(r["requests"] for r in totals.collect()) == 120 and totals.count() == 2


def test_forecast(spark):
    logs = [log_row(K[0], f"2024-01-{d:02d} 10:00:00", 2.0) for d in range(10, 17)] + [log_row(K[0], "2024-01-17 09:00:00", 50.0)]
    logs += [log_row(K[1], "2024-01-02 10:00:00", 30.0), log_row(K[2], "2024-01-16 10:00:00", 7.0)]
    t = make_tables(spark, logs, [key_row(K[0], 20.0), key_row(K[1], 25.0), key_row(K[2], 10.5), key_row(K[3], 5.0)])
    got = {r["api_key"]: tuple(r)[1:] for r in forecast.forecast(t, AS_OF).collect()}
    assert got[K[0]] == (14.0, 2.0, 44.0, 20.0, 44 / 20 * 100, "exceeded", date(2024, 1, 19))       # three more days
    assert got[K[1]][:3] == (30.0, 0.0, 30.0) and got[K[1]][-1] == date(2024, 1, 16)              # used up already
    assert got[K[2]][:3] == (7.0, 1.0, 22.0) and got[K[2]][-1] == date(2024, 1, 20)
    assert got[K[3]] == (0.0, 0.0, 0.0, 5.0, 0.0, "normal", None)
    at_risk = forecast.newly_at_risk(forecast.forecast(t, AS_OF), budgets.budget_report(t, AS_OF))
    assert rows(at_risk, "api_key") == [(K[2],)]
    # on the first of a month the rate comes from the month before
    first = {r["api_key"]: r["projected"] for r in forecast.forecast(t, datetime(2024, 2, 1, 8)).collect()}
    assert first == dict.fromkeys(K[:4], 0.0)


def test_csv_round_trip(spark):
    data = [("a,b", 'say "x"', None, 1.5, datetime(2024, 1, 2, 3, 4, 5, 6), date(2024, 1, 2)), ("", "line\nbreak", "é😀", None, None, None), (None, "'", "\\", -0.1, None, None)]
    df = spark.createDataFrame(data, "a string, b string, c string, x double, t timestamp_ntz, d date")
    path = work_dir(spark, "t-csv")
    write_csv(df, path)
    assert rows(read_csv(spark, path, df.schema)) == rows(df)


def test_periods_of_a_column_agree_with_the_parser(spark):
    texts = ["today", "week", "month", "Month", "", " week", "year", None]

    def parsed(x):
        try:
            return bool(parse_period(x))
        except ValueError:
            return False
    got = spark.createDataFrame([(x,) for x in texts], "p string").select("p", valid_period(F.col("p")).alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in got} == {x: parsed(x) for x in texts}


def test_rates_hold_until_the_next_one(spark):
    given = [("USD", date(2023, 12, 20), 2.0), ("USD", date(2024, 1, 10), 3.0), ("USD", date(2024, 1, 10), 2.5), ("GBP", date(2024, 1, 4), 5.0),
             ("GBP", date(2024, 2, 9), 9.0), (None, date(2024, 1, 1), 1.0), ("CHF", None, 1.0), ("CHF", date(2024, 1, 1), None)]
    rates = spark.createDataFrame(given, "currency string, day date, rate double")
    days = {(r["currency"], r["day"].day): float(r["rate"]) for r in currencies.rate_days(rates, day_range(date(2024, 1, 1), date(2024, 1, 31))).collect()}
    assert days == {("USD", d): 2.0 if d < 10 else 3.0 for d in range(1, 32)} | {("GBP", d): 5.0 for d in range(4, 32)}
    t = make_tables(spark, [log_row(K[0], "2024-01-02 10:00:00", 1.5), log_row(K[0], "2024-01-12 10:00:00", 1.0)], [])
    got = rows(currencies.spend_in_currencies(t, rates, ["USD", "GBP", "CHF"], datetime(2024, 1, 17)), "currency", "converted", "without_rate")
    assert got == [("CHF", None, 2.5), ("GBP", 5.0, 1.5), ("USD", 6.0, 0.0)]
