from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from build import AS_OF, at, dicts, events

from tallyroom import clock
from tallyroom.sources.files import append_events


def test_days_start_at_midnight_and_end_now():
    bounds = clock.date_range(AS_OF, 30)
    assert (bounds.lo, bounds.hi) == (at("2023-12-31"), AS_OF)


def test_given_days_count_in_full():
    bounds = clock.date_range(AS_OF, start="2024-01-02", end="2024-01-03")
    assert (bounds.lo, bounds.hi) == (at("2024-01-02"), at("2024-01-03T23:59:59.999"))
    assert bounds.days == 2


def test_one_missing_end_falls_back_to_days():
    assert clock.date_range(AS_OF, 7, start="2024-01-02").lo == at("2024-01-23")


def test_lower_bounds():
    assert clock.since(AS_OF, 7).lo == at("2024-01-23T12:00:00")
    assert clock.since_midnight(AS_OF, 7).lo == at("2024-01-23")
    assert clock.trailing_range(AS_OF, 90).lo == AS_OF - timedelta(days=90)


def test_sync_and_lagged_windows():
    window = clock.sync_window(AS_OF, 7)
    assert (window.lo, window.hi, window.hi_open) == (at("2024-01-23"), at("2024-01-31"), True)
    late = clock.lagged_window(AS_OF, 28)
    assert (late.lo, late.hi.date()) == (at("2023-12-31"), date(2024, 1, 28))


def test_aware_moments_become_utc():
    paris = timezone(timedelta(hours=1))
    assert clock.resolve(datetime(2024, 1, 1, 1, tzinfo=paris)) == at("2024-01-01")


def test_negative_days_are_refused():
    with pytest.raises(ValueError):
        clock.since(AS_OF, -1)


def test_both_ends_belong_to_the_window(spark):
    df = events(spark, dict(ts="2024-01-02T00:00:00"), dict(ts="2024-01-02T23:59:59.999"),
                dict(ts="2024-01-02T23:59:59.999500"), dict(ts="2024-01-01T23:59:59"))
    kept = clock.date_range(start="2024-01-02", end="2024-01-02").apply(df, "event_ts")
    assert sorted(r["id"] for r in dicts(kept)) == [0, 1]


def test_bounds_reach_the_scan_for_both_time_types(spark, tmp_path):
    df = events(spark, dict(ts="2024-01-02T10:00:00"), dict(ts="2024-01-20T10:00:00"))
    for kind in ("timestamp", "timestamp_ntz"):
        path = str(tmp_path / kind)
        append_events(df.withColumn("event_ts", df.event_ts.cast(kind)), path)
        stored = clock.since_midnight(AS_OF, 20).apply(spark.read.parquet(path), "event_ts")
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(event_ts" in plan
        assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert [r["id"] for r in dicts(stored)] == [1]
