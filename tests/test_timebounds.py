from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from spendlens.timebounds import since_bound, window_bound

LA = ZoneInfo("America/Los_Angeles")
NOW = datetime(2026, 7, 8, 12, tzinfo=LA)


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "spec, expected",
    [
        ("30m", "2026-07-08T18:30:00"),
        ("2h", "2026-07-08T17:00:00"),
        (" 7d ", "2026-07-01T19:00:00"),
        ("today", "2026-07-08T07:00:00"),
        ("TODAY", "2026-07-08T07:00:00"),
        ("2026-07-18T10:00:00+08:00", "2026-07-18T02:00:00"),
        ("2026-07-18T10:00:00Z", "2026-07-18T10:00:00"),
        ("2026-07-01", "2026-07-01T00:00:00"),
        ("2026-07", "2026-07-01T00:00:00"),
        ("2026", "2026-01-01T00:00:00"),
        # Texts that are no dates still bound the ISO text of the times.
        ("2026-07-1", "2026-07-10T00:00:00"),
        ("2026-7", "2027-01-01T00:00:00"),
        ("2026-02-30", "2026-03-01T00:00:00"),
        ("20260701", "2027-01-01T00:00:00"),
    ],
)
def test_since(spec, expected):
    assert since_bound(spec, NOW, LA) == utc(expected)


def test_days_are_calendar_days_across_a_clock_change():
    now = datetime(2026, 3, 9, 12, tzinfo=LA)
    assert since_bound("2d", now, LA) == utc("2026-03-07T20:00:00")
    assert since_bound("48h", now, LA) == utc("2026-03-07T19:00:00")


@pytest.mark.parametrize(
    "spec", ["yesterday", "5x", "m", "", "-3d", "2026-07-18T10:00:00", "12:30", "99999999999d"]
)
def test_rejected(spec):
    with pytest.raises(ValueError):
        since_bound(spec, NOW, LA)


@pytest.mark.parametrize(
    "period, now, expected",
    [
        ("day", NOW, "2026-07-08T07:00:00"),
        ("week", NOW, "2026-07-06T07:00:00"),
        ("month", NOW, "2026-07-01T07:00:00"),
        ("week", datetime(2026, 3, 9, 12, tzinfo=LA), "2026-03-09T07:00:00"),
        ("24h", NOW, "2026-07-07T19:00:00"),
    ],
)
def test_windows(period, now, expected):
    assert window_bound(period, now, LA) == utc(expected)


def test_window_rejects_other_words():
    with pytest.raises(ValueError):
        window_bound("yesterday", NOW, LA)
