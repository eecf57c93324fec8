"""Hand-worked tiny tables for each semantic rule."""

from datetime import datetime

import pytest

from costlens.operators import adhoc, admin, breakdowns, budgets
from costlens.operators.quality import SHARE_RULES, duplicate_keys, violations
from costlens.sources.load import merged, new_rows
from tests.conftest import AS_OF, key_row, log_row, make_tables, rows, sha

K1, K2, K3 = sha("sk-a"), sha("sk-b"), sha("sk-gone")


def test_null_and_empty_models_skipped_only_in_breakdowns(spark):
    # the reference repository's one value-level test, plus the total
    t = make_tables(spark, [log_row(K1, "2024-01-10 10:00:00", 1.23, model=""),
                            log_row(K1, "2024-01-10 11:00:00", 2.34, model=None),
                            log_row(K1, "2024-01-10 12:00:00", 0.5, model="gpt-4")],
                    [key_row(K1, 100)])
    bm = breakdowns.by_model(t, AS_OF, "month").collect()
    assert [(r["model"], r["spend"], r["percentage"]) for r in bm] == [("gpt-4", 0.5, 100.0)]
    tot = breakdowns.total_spend(t, AS_OF, "month").collect()
    assert tot[0]["spend"] == pytest.approx(4.07)


def test_trailing_slash_share_stays_in_denominator(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-10 10:00:00", 1.0, model="openai/"),
                            log_row(K1, "2024-01-10 11:00:00", 3.0, model="openai/gpt-4"),
                            log_row(K1, "2024-01-10 12:00:00", 1.0, model="gpt-4"),
                            log_row(K1, "2024-01-11 12:00:00", 2.0, model="claude"),
                            log_row(K1, "2024-01-11 12:00:00", 1.0, model="openai/")],
                    [key_row(K1, 100)])
    bm = {r["model"]: r for r in breakdowns.by_model(t, AS_OF, "month").collect()}
    assert set(bm) == {"gpt-4", "claude"}                 # '' dropped after the share
    assert bm["gpt-4"]["spend"] == 4.0 and bm["gpt-4"]["requests"] == 2
    assert bm["gpt-4"]["percentage"] == pytest.approx(50.0)
    assert sum(r["percentage"] for r in bm.values()) == pytest.approx(75.0)
    # the all-keys path keeps 'openai/' as its own model
    adm = admin.key_day_model(t, AS_OF)
    assert ("openai/",) in rows(adm.select("model").distinct())


def test_closed_range_bounds(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-17 00:00:00", 1.0),
                            log_row(K1, "2024-01-17 23:59:59.999999", 2.0),
                            log_row(K1, "2024-01-18 00:00:00", 4.0),
                            log_row(K1, "2024-01-16 23:59:59.999999", 8.0)],
                    [key_row(K1, 100)])
    today = breakdowns.total_spend(t, AS_OF, "today").collect()[0]["spend"]
    assert today == 3.0


def test_week_and_month_include_future_rows_of_month_only(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-15 00:00:00", 1.0),
                            log_row(K1, "2024-01-14 23:00:00", 2.0),
                            log_row(K1, "2024-01-18 09:00:00", 4.0),     # after today
                            log_row(K1, "2024-01-31 23:59:59.5", 8.0),   # last second, fraction
                            log_row(K1, "2024-02-01 00:00:00", 16.0)],
                    [key_row(K1, 100)])
    assert breakdowns.total_spend(t, AS_OF, "week").collect()[0]["spend"] == 1.0
    assert breakdowns.total_spend(t, AS_OF, "month").collect()[0]["spend"] == 15.0
    # the SQL month window ends at :59 flat and loses the fraction
    s = adhoc.alias_month_summary(
        make_tables(spark, [log_row(K1, "2024-01-31 23:59:59.5", 8.0),
                            log_row(K1, "2024-01-31 23:59:59", 1.0)],
                    [key_row(K1, 100, alias="eng")]), AS_OF, "eng").collect()
    assert s[0]["month_spend"] == 1.0


def test_budget_default_and_states(spark):
    keys = [key_row(sha("sk-80"), 100), key_row(sha("sk-100"), 50), key_row(sha("sk-null")),
            key_row(sha("sk-zero"), 0.0), key_row(sha("sk-neg"), -5.0), key_row(sha("sk-none"), 10)]
    logs = [log_row(sha("sk-80"), "2024-01-02 10:00:00", 80.0),
            log_row(sha("sk-100"), "2024-01-02 10:00:00", 50.0),
            log_row(sha("sk-null"), "2024-01-02 10:00:00", 30.0),
            log_row(sha("sk-zero"), "2024-01-02 10:00:00", 5.0),
            log_row(sha("sk-neg"), "2024-01-02 10:00:00", 19.99)]
    b = {r["api_key"]: r for r in budgets.budget_report(make_tables(spark, logs, keys), AS_OF).collect()}
    assert b[sha("sk-80")]["state"] == "warning" and b[sha("sk-80")]["used_percent"] == 80.0
    assert b[sha("sk-100")]["state"] == "exceeded"
    assert b[sha("sk-null")]["monthly_budget"] == 25.0 and b[sha("sk-null")]["remaining"] == -5.0
    assert b[sha("sk-null")]["state"] == "exceeded"
    assert b[sha("sk-zero")]["monthly_budget"] == 25.0 and b[sha("sk-zero")]["state"] == "normal"
    assert b[sha("sk-neg")]["monthly_budget"] == 25.0
    assert b[sha("sk-none")]["spent"] == 0.0 and b[sha("sk-none")]["state"] == "normal"
    assert b[sha("sk-80")]["warning_threshold"] == 80.0
    over = {r["api_key"]: r for r in budgets.over_budget(
        budgets.budget_report(make_tables(spark, logs, keys), AS_OF)).collect()}
    assert set(over) == {sha("sk-80"), sha("sk-100"), sha("sk-null")}
    assert over[sha("sk-80")]["is_warning"] and not over[sha("sk-80")]["is_exceeded"]


def test_budget_lookup_missing_key(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-02 10:00:00", 1.0),
                            log_row(K3, "2024-01-02 10:00:00", 1.0)],
                    [key_row(K1, 40)])
    got = {r["api_key"]: (r["max_budget"], r["budget_source"])
           for r in budgets.budget_lookup(t.logs.select("api_key").distinct(), t.keys).collect()}
    assert got == {K1: (40.0, "max_budget"), K3: (25.0, "default_missing_key")}


def test_summary_uses_period_spend_and_monthly_cap(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-17 10:00:00", 5.0),
                            log_row(K1, "2024-01-03 10:00:00", 15.0)], [key_row(K1, 50)])
    s = budgets.summary(t, AS_OF, "today").collect()[0]
    assert (s["spend"], s["budget"], s["remaining"], s["budget_used_percent"]) == (5.0, 50.0, 45.0, 10.0)


def test_project_hidden_at_zero_spend_but_daily_kept(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-05 10:00:00", 0.0),
                            log_row(K2, "2024-01-05 10:00:00", 2.0),
                            log_row(K2, "2024-01-06 10:00:00", 0.0)],
                    [key_row(K1), key_row(K2)])
    proj = breakdowns.by_project(t, AS_OF, "month").collect()
    assert [(r["api_key"], r["project"], r["percentage"]) for r in proj] == [(K2, "global", 100.0)]
    days = rows(breakdowns.daily(t, AS_OF, "month"), "api_key", "date", "spend")
    assert (K1, datetime(2024, 1, 5), 0.0) in days and (K2, datetime(2024, 1, 6), 0.0) in days


def test_admin_keeps_orphans_and_shared_alias(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-05 10:00:00", 1.0, model="openai/gpt-4"),
                            log_row(K1, "2024-01-05 11:00:00", 2.0, model="gpt-4"),
                            log_row(K2, "2024-01-05 10:00:00", 4.0),
                            log_row(K3, "2024-01-05 10:00:00", 8.0)],
                    [key_row(K1, alias="eng"), key_row(K2, alias="eng")])
    got = rows(admin.key_day_model(t, AS_OF), "api_key", "key_alias", "model", "spend", "requests")
    assert got == sorted([(K1, "eng", "gpt-4", 3.0, 2), (K2, "eng", "gpt-4", 4.0, 1),
                          (K3, None, "gpt-4", 8.0, 1)], key=repr)
    # the alias report merges both keys of the alias, raw model names
    bm = rows(adhoc.alias_by_model(t, AS_OF, "eng"), "model", "spend", "requests")
    assert bm == [("gpt-4", 6.0, 2), ("openai/gpt-4", 1.0, 1)]
    # an empty range (start after end) is not an error
    assert admin.key_day_model(t, AS_OF, start=datetime(2024, 1, 20),
                               end=datetime(2024, 1, 10)).count() == 0


def test_alias_summary_null_budget_has_no_percent(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-05 10:00:00", 1.23456)],
                    [key_row(K1, None, alias="eng"), key_row(K2, 0.0, alias="eng")])
    got = {r["token"]: r for r in adhoc.alias_month_summary(t, AS_OF, "eng").collect()}
    assert got[K1]["month_spend"] == 1.2346 and got[K1]["remaining"] is None
    assert got[K1]["used_percent"] is None and got[K2]["used_percent"] is None
    assert got[K2]["month_spend"] == 0.0


def test_one_key_filter_is_pushed_down(spark):
    t = make_tables(spark, [log_row(sha("sk-a"), "2024-01-05 10:00:00", 1.0),
                            log_row(K2, "2024-01-05 10:00:00", 2.0)],
                    [key_row(sha("sk-a")), key_row(K2)])
    got = breakdowns.by_model(breakdowns.one_key(t, "Bearer sk-a"), AS_OF, "month").collect()
    assert [(r["api_key"], r["spend"]) for r in got] == [(sha("sk-a"), 1.0)]


def test_idempotent_load_and_duplicates(spark):
    old = make_tables(spark, [log_row(K1, "2024-01-05 10:00:00", 1.0, request_id="a"),
                              log_row(K1, "2024-01-05 11:00:00", 2.0, request_id="b")], []).logs
    inc = make_tables(spark, [log_row(K1, "2024-01-05 11:00:00", 2.0, request_id="b"),
                              log_row(K1, "2024-01-06 11:00:00", 3.0, request_id="c"),
                              log_row(K1, "2024-01-06 11:00:00", 3.0, request_id="c")], []).logs
    assert rows(new_rows(old, inc), "request_id") == [("c",)]
    assert rows(merged(old, inc), "request_id") == [("a",), ("b",), ("c",)]
    assert rows(duplicate_keys(inc, "request_id")) == [("c", 2)]


def test_violations_flag_bad_rows(spark):
    df = spark.createDataFrame([("k1", -1.0, 120.0, 1, 1, 1, 1), ("k2", 1.0, 50.0, 1, 1, 1, 1)],
                               "api_key string, spend double, percentage double, requests long, "
                               "tokens long, prompt_tokens long, completion_tokens long")
    got = rows(violations(df, "by_model", SHARE_RULES), "row_id", "field")
    assert got == [("k1", "percentage"), ("k1", "spend")]


def test_ordering_helpers(spark):
    t = make_tables(spark, [log_row(K1, "2024-01-05 10:00:00", 1.0, model="a"),
                            log_row(K1, "2024-01-06 10:00:00", 3.0, model="b"),
                            log_row(K1, "2024-01-07 10:00:00", 3.0, model="c")], [key_row(K1)])
    bm = breakdowns.order_models(breakdowns.by_model(t, AS_OF, "month")).collect()
    assert [r["model"] for r in bm] == ["b", "c", "a"]
    d = breakdowns.order_days_desc(breakdowns.daily(t, AS_OF, "month")).collect()
    assert [r["date"].day for r in d] == [7, 6, 5]


def test_tiny_and_missing_amounts(spark):
    from costlens.operators import breakdowns, quality
    from costlens.session import work_dir
    from tests.conftest import key_row, log_row, make_tables, sha
    k = sha("sk-tiny")
    logs = [log_row(k, "2024-01-02 10:00:00", 4e-11) for _ in range(1000)]
    logs += [log_row(k, "2024-01-03 10:00:00", float("nan"), request_id="nan"),
             log_row(k, "2024-01-04 10:00:00", -2.0, request_id="minus")]
    t = make_tables(spark, logs, [key_row(k)])
    days = {r["date"].day: r["spend"] for r in breakdowns.daily(t, AS_OF, "month").collect()}
    assert days == {2: 4e-8, 3: 0.0, 4: -2.0}
    bad = quality.report_violations(t, AS_OF, work_dir(spark, "t-nan") + "/rollup").collect()
    assert {r["row_id"] for r in bad if r["report"] == "log"} == {"nan", "minus"}
    assert {r["report"] for r in bad} == {"log", "summary", "by_model", "by_project", "daily", "budget", "admin"}
    missing = quality.violations(spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 1.0)], "api_key string, spend double"),
                                 "r", {"spend": (0, None)})
    assert sorted(r["row_id"] for r in missing.collect()) == ["a", "b"]


def test_pivot_keeps_spend_of_undeclared_models(spark):
    from costlens.operators import admin
    from tests.conftest import key_row, log_row, make_tables, sha
    k = sha("sk-p")
    t = make_tables(spark, [log_row(k, "2024-01-02 10:00:00", x, model=m) for m, x in (("a", 1.0), ("b", 2.0), ("c", 4.0))],
                    [key_row(k)])
    assert tuple(admin.admin_pivot(t, AS_OF, ["a", "z"]).first())[2:] == (1.0, None, 6.0)


def test_alias_days_in_order(spark):
    from costlens.operators import adhoc
    df = spark.createDataFrame([("2024-01-03", 1.0), ("2024-01-01", 2.0)], "date string, spend double")
    assert [r["date"] for r in adhoc.order_by_date(df).collect()] == ["2024-01-01", "2024-01-03"]
