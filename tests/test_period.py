from datetime import datetime

from orderlens.functions.period import EPOCH_MIN, period_bounds, timeline_unit

N = datetime(2001, 7, 31, 12, 0, 0)


def test_today_week_month_all():
    assert period_bounds("today", N) == (datetime(2001, 7, 31), N)
    assert period_bounds("week", N) == (datetime(2001, 7, 24, 12), N)
    assert period_bounds("month", N) == (datetime(2001, 7, 1), N)
    assert period_bounds("anything", N) == (EPOCH_MIN, N)


def test_yesterday_ends_at_last_microsecond():
    assert period_bounds("yesterday", N) == (datetime(2001, 7, 30), datetime(2001, 7, 30, 23, 59, 59, 999999))


def test_last_month_leap_and_january():
    assert period_bounds("last_month", datetime(2004, 3, 15, 8)) == (
        datetime(2004, 2, 1), datetime(2004, 2, 29, 23, 59, 59, 999999))
    assert period_bounds("last_month", datetime(2001, 1, 5)) == (
        datetime(2000, 12, 1), datetime(2000, 12, 31, 23, 59, 59, 999999))


def test_timeline_units():
    assert [timeline_unit(p) for p in ("today", "week", "month", "all", "other")] == [
        "hour", "day", "day", "month", "month"]
