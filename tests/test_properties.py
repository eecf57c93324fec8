"""Cross-report properties on the sf0.001 stand-in tables."""

from pyspark.sql import functions as F

from costlens.operators import admin, breakdowns, budgets
from costlens.operators.facts import Rollup, daily_rollup
from costlens.periods import period_range
from costlens.sources.testdata import load_tables
from tests.conftest import AS_OF, SF0001, rows


def test_by_model_never_exceeds_total(spark):
    t = load_tables(spark, SF0001)
    bm = breakdowns.by_model(t, AS_OF, "month").groupBy("api_key").agg(F.sum("spend").alias("m"))
    tot = breakdowns.total_spend(t, AS_OF, "month")
    bad = bm.join(tot, "api_key").where(F.col("m") > F.col("spend") + 1e-9)
    assert bad.count() == 0
    shares = breakdowns.by_model(t, AS_OF, "month").groupBy("api_key").agg(
        F.sum("percentage").alias("p"))
    assert shares.where(F.col("p") > 100.0 + 1e-9).count() == 0


def test_admin_rollup_by_key_equals_filtered_totals(spark):
    t = load_tables(spark, SF0001)
    cube = admin.admin_rollup(t, AS_OF).where("grouping_id = 3")   # by api_key only
    adm = admin.key_day_model(t, AS_OF).groupBy("api_key").agg(F.sum("requests").alias("r"))
    assert rows(cube.select("api_key", "requests")) == rows(adm)
    overall = admin.admin_rollup(t, AS_OF).where("grouping_id = 7").first()
    n = t.logs.where(period_range("month", AS_OF).contains(F.col("startTime"))) \
        .where("model is not null and model <> ''").count()
    assert overall["requests"] == n


def test_reports_from_rollup_equal_reports_from_log(spark):
    t = load_tables(spark, SF0001)
    rng = period_range("month", AS_OF)
    roll = Rollup(daily_rollup(t.logs, rng), rng.first_day, rng.last_day)
    for fn in (breakdowns.by_model, breakdowns.by_project, breakdowns.daily, budgets.summary):
        assert rows(fn(t, AS_OF, "week", rollup=roll)) == rows(fn(t, AS_OF, "week"))
    assert rows(admin.key_day_model(t, AS_OF, rollup=roll)) == rows(admin.key_day_model(t, AS_OF))


def test_union_of_day_splits_is_the_whole(spark):
    t = load_tables(spark, SF0001)
    week = breakdowns.daily(t, AS_OF, "week")
    month = breakdowns.daily(t, AS_OF, "month").where(F.col("date") >= F.lit("2024-01-15").cast("timestamp_ntz")) \
        .where(F.col("date") <= F.lit("2024-01-17").cast("timestamp_ntz"))
    assert rows(week.drop("period")) == rows(month.drop("period"))


def test_reports_do_not_depend_on_session_time_zone(spark):
    t = load_tables(spark, SF0001)
    prev = spark.conf.get("spark.sql.session.timeZone")
    results = []
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            results.append((rows(breakdowns.daily(t, AS_OF, "week")),
                            rows(admin.key_day_model(t, AS_OF)),
                            rows(budgets.summary(t, AS_OF, "today"))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert results[0] == results[1] == results[2]
