from datetime import datetime

import pytest

from costlens.periods import Period, admin_range, month_sql_window, parse_period, period_range


def test_wednesday_bounds():
    now = datetime(2024, 1, 17, 15, 30)
    t = period_range("today", now)
    assert (t.start, t.end) == (datetime(2024, 1, 17), datetime(2024, 1, 17, 23, 59, 59, 999999))
    w = period_range(Period.WEEK, now)
    assert (w.start, w.end) == (datetime(2024, 1, 15), datetime(2024, 1, 17, 23, 59, 59, 999999))
    m = period_range("month", now)
    assert (m.start, m.end) == (datetime(2024, 1, 1), datetime(2024, 1, 31, 23, 59, 59, 999999))


def test_week_on_monday_and_sunday():
    mon = period_range("week", datetime(2024, 1, 15, 8))
    assert mon.start == datetime(2024, 1, 15) and mon.end.date() == datetime(2024, 1, 15).date()
    sun = period_range("week", datetime(2024, 1, 21, 8))
    assert sun.start == datetime(2024, 1, 15) and sun.end.date() == datetime(2024, 1, 21).date()


def test_week_can_start_in_previous_month():
    w = period_range("week", datetime(2024, 2, 1, 9))  # a Thursday
    assert w.start == datetime(2024, 1, 29)
    assert period_range("month", datetime(2024, 2, 1, 9)).start == datetime(2024, 2, 1)


def test_december_and_leap_february():
    d = period_range("month", datetime(2024, 12, 5))
    assert d.end == datetime(2024, 12, 31, 23, 59, 59, 999999)
    f = period_range("month", datetime(2024, 2, 10))
    assert f.end == datetime(2024, 2, 29, 23, 59, 59, 999999)
    f23 = period_range("month", datetime(2023, 2, 10))
    assert f23.end == datetime(2023, 2, 28, 23, 59, 59, 999999)


def test_sql_month_window_ends_on_whole_second():
    w = month_sql_window(datetime(2024, 1, 17, 15, 30))
    assert w.start == datetime(2024, 1, 1) and w.end == datetime(2024, 1, 31, 23, 59, 59)
    assert month_sql_window(datetime(2024, 12, 3)).end == datetime(2024, 12, 31, 23, 59, 59)


def test_admin_range_overrides_each_bound():
    now = datetime(2024, 1, 17)
    r = admin_range(now, start=datetime(2024, 1, 10))
    assert r.start == datetime(2024, 1, 10) and r.end == datetime(2024, 1, 31, 23, 59, 59, 999999)
    r = admin_range(now, end=datetime(2024, 1, 5))
    assert r.start == datetime(2024, 1, 1) and r.end == datetime(2024, 1, 5)


def test_bad_period_is_rejected():
    with pytest.raises(ValueError):
        parse_period("year")
    with pytest.raises(ValueError):
        period_range("", datetime(2024, 1, 1))
