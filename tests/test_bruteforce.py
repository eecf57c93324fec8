"""Reports vs a plain-Python brute force of the documented rules, on random logs."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from costlens.operators import admin, breakdowns, budgets
from costlens.periods import period_range
from tests.conftest import AS_OF, key_row, log_row, make_tables, sha

KEYS = [sha(f"sk-{i}") for i in range(4)]
ORPHAN = sha("sk-orphan")
MODELS = [None, "", "openai/", "gpt-4", "openai/gpt-4", "azure/openai/gpt-4", "claude", "a/"]
BASE = datetime(2024, 1, 14)

row = st.tuples(st.sampled_from(KEYS + [ORPHAN]), st.integers(0, 5 * 24 * 60 - 1),
                st.sampled_from(MODELS), st.integers(0, 5000))
logs_strategy = st.lists(row, min_size=0, max_size=40)
caps = st.lists(st.sampled_from([None, 0.0, -1.0, 5.0, 20.0, 60.0]), min_size=4, max_size=4)
SETTINGS = settings(max_examples=5, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _build(spark, raw, budgets_):
    logs = [log_row(k, (BASE + timedelta(minutes=m)).isoformat(sep=" "), cents / 100, model=mdl,
                    prompt=cents % 7, completion=cents % 3)
            for k, m, mdl, cents in raw]
    keys = [key_row(k, b, alias="team") for k, b in zip(KEYS, budgets_)]
    return make_tables(spark, logs, keys), logs


def _in(r, rng):
    return rng.start <= r["startTime"] <= rng.end


def _per_key_name(m):
    return m.split("/", 1)[1] if "/" in m else m


def _all_keys_name(m):
    rest = m.split("/", 1)[1] if "/" in m else m
    return rest or m


@SETTINGS
@given(raw=logs_strategy, budgets_=caps)
def test_by_model_matches_brute_force(spark, raw, budgets_):
    t, logs = _build(spark, raw, budgets_)
    rng = period_range("week", AS_OF)
    want = {}
    for k in KEYS:
        merged = defaultdict(lambda: [0.0, 0, 0])
        for r in logs:
            if r["api_key"] == k and _in(r, rng) and r["model"]:
                acc = merged[_per_key_name(r["model"])]
                acc[0] += r["spend"]
                acc[1] += 1
                acc[2] += r["total_tokens"]
        total = sum(v[0] for v in merged.values())
        for name, (s, n, tok) in merged.items():
            if name:
                want[(k, name)] = (s, s / total * 100 if total > 0 else 0.0, n, tok)
    got = {(r["api_key"], r["model"]): (r["spend"], r["percentage"], r["requests"], r["tokens"])
           for r in breakdowns.by_model(t, AS_OF, "week").collect()}
    assert set(got) == set(want)
    for k, (s, p, n, tok) in want.items():
        assert got[k][0] == pytest.approx(s) and got[k][1] == pytest.approx(p)
        assert got[k][2:] == (n, tok)


@SETTINGS
@given(raw=logs_strategy, budgets_=caps)
def test_budget_and_summary_match_brute_force(spark, raw, budgets_):
    t, logs = _build(spark, raw, budgets_)
    month, today = period_range("month", AS_OF), period_range("today", AS_OF)
    got_b = {r["api_key"]: r for r in budgets.budget_report(t, AS_OF).collect()}
    got_s = {r["api_key"]: r for r in budgets.summary(t, AS_OF, "today").collect()}
    assert set(got_b) == set(KEYS) == set(got_s)
    for k, cap in zip(KEYS, budgets_):
        budget = cap if cap is not None and cap > 0 else 25.0
        spent = sum(r["spend"] for r in logs if r["api_key"] == k and _in(r, month))
        pct = spent / budget * 100 if budget > 0 else 0.0
        state = "exceeded" if pct >= 100 else "warning" if pct >= 80 else "normal"
        b = got_b[k]
        assert b["monthly_budget"] == budget and b["spent"] == pytest.approx(spent)
        assert b["remaining"] == pytest.approx(budget - spent)
        assert b["state"] == state or abs(pct - 80) < 1e-9 or abs(pct - 100) < 1e-9
        day_spent = sum(r["spend"] for r in logs if r["api_key"] == k and _in(r, today))
        assert got_s[k]["spend"] == pytest.approx(day_spent)


@SETTINGS
@given(raw=logs_strategy, budgets_=caps)
def test_all_keys_report_matches_brute_force(spark, raw, budgets_):
    t, logs = _build(spark, raw, budgets_)
    rng = period_range("month", AS_OF)
    want = defaultdict(lambda: [0.0, 0, 0, 0, 0])
    for r in logs:
        if _in(r, rng) and r["model"]:
            acc = want[(r["api_key"], r["startTime"].date(), _all_keys_name(r["model"]))]
            acc[0] += r["spend"]
            acc[1] += 1
            acc[2] += r["total_tokens"]
            acc[3] += r["prompt_tokens"]
            acc[4] += r["completion_tokens"]
    got = {(r["api_key"], r["day"], r["model"]): r for r in admin.key_day_model(t, AS_OF).collect()}
    assert set(got) == set(want)
    for key, (s, n, tok, p, c) in want.items():
        r = got[key]
        assert r["spend"] == pytest.approx(s)
        assert (r["requests"], r["tokens"], r["prompt_tokens"], r["completion_tokens"]) == (n, tok, p, c)
        assert (r["key_alias"] is None) == (key[0] == ORPHAN)


@SETTINGS
@given(raw=logs_strategy, budgets_=caps)
def test_daily_and_project_match_brute_force(spark, raw, budgets_):
    t, logs = _build(spark, raw, budgets_)
    rng = period_range("month", AS_OF)
    day = defaultdict(lambda: [0.0, 0])
    proj = defaultdict(float)
    for r in logs:
        if r["api_key"] in KEYS and _in(r, rng):
            acc = day[(r["api_key"], r["startTime"].date())]
            acc[0] += r["spend"]
            acc[1] += 1
            proj[r["api_key"]] += r["spend"]
    got_d = {(r["api_key"], r["date"].date()): (r["spend"], r["requests"])
             for r in breakdowns.daily(t, AS_OF, "month").collect()}
    assert set(got_d) == set(day)
    for k, (s, n) in day.items():
        assert got_d[k][0] == pytest.approx(s) and got_d[k][1] == n
    got_p = {r["api_key"]: r["spend"] for r in breakdowns.by_project(t, AS_OF, "month").collect()}
    assert set(got_p) == {k for k, s in proj.items() if round(s, 6) != 0}
