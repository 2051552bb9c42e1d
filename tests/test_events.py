from __future__ import annotations

import pytest
from build import AS_OF, at, dicts, events, only

from tallyroom import clock
from tallyroom.functions import as_int, prop
from tallyroom.operators import events as ev, feeds, rollup

WEEK = clock.date_range(AS_OF, 7)


def test_recent_feed_keeps_to_the_limit_and_uses_arrival_time(spark):
    df = events(spark, *[dict(ts="2024-01-01T00:00:00", created_at=at("2024-01-01"))] * 120)
    assert feeds.recent_events(df, 500).count() == 120
    assert feeds.recent_events(df).count() == 50 and feeds.recent_events(df, 0).count() == 0
    with pytest.raises(ValueError):
        feeds.recent_events(df, -1)
    late = df.withColumn("event_ts", df.event_ts.cast("string")).selectExpr(
        "* except (event_ts)", "CASE WHEN id = 3 THEN NULL ELSE TIMESTAMP '2023-01-01' END AS event_ts")
    top = feeds.recent_events(late, 1).collect()
    assert top[0]["event_ts"] is None


def test_search_conditions_and_total(spark):
    df = events(spark, dict(ts="2024-01-02T10:00:00", name="a", device_id="x"),
                dict(ts="2024-01-03T23:59:59", name="a", device_id="x"),
                dict(ts="2024-01-04T00:00:00", name="a", device_id="y"))
    page = feeds.search_events(df, name="a", date_to="2024-01-03", limit=1)
    assert [r["id"] for r in dicts(page.rows)] == [1]
    assert only(page.total) == {"total": 2}
    day = feeds.search_events(df, date="2024-01-04", date_to="2024-01-01")
    assert [r["id"] for r in dicts(day.rows)] == [2]


def test_equal_times_are_ordered_by_id(spark):
    df = events(spark, *[dict(ts="2024-01-02T10:00:00")] * 5)
    page = feeds.search_events(df, limit=2, offset=1)
    assert [r["id"] for r in dicts(page.rows)] == [3, 2]


def test_property_default_counts_missing_and_null(spark):
    df = events(spark, dict(ts="2024-01-29T00:00:00", properties='{"source":null}'),
                dict(ts="2024-01-29T00:00:00", properties="{}"),
                dict(ts="2024-01-29T00:00:00", properties='{"source":"widget"}'))
    page = feeds.events_by_property(df, "app_opened", "source", "app", "app", AS_OF)
    assert only(page.total) == {"total": 2, "unique_users": 1}
    bare = feeds.events_by_property(df, "app_opened", "source", "app", None, AS_OF)
    assert only(bare.total)["total"] == 0
    groups = dicts(ev.property_breakdown(df, "app_opened", "source"))
    assert {(g["source"], g["count"]) for g in groups} == {(None, 2), ("widget", 1)}


def test_breakdown_map_holds_every_value(spark):
    counts = spark.range(20_000).selectExpr("CAST(id AS STRING) AS k", "1L AS count")
    assert only(ev.breakdown_map(counts, "k").selectExpr("size(counts) AS n"))["n"] == 20_000


def test_all_values_of_a_dimension_unless_cut(spark):
    df = events(spark, *[dict(ts="2024-01-29T00:00:00", device_model=f"m{i}") for i in range(30)])
    assert ev.dimension_breakdown(df, "device_model").count() == 30
    assert ev.dimension_breakdown(df, "device_model", k=4).count() == 4


def test_last_hour_excludes_its_first_instant(spark):
    df = events(spark, dict(ts="2024-01-30T11:00:00"), dict(ts="2024-01-30T11:00:00.000001"))
    assert only(ev.recent_event_counts(df, AS_OF))["count"] == 1


def test_top_counts_break_ties_by_name(spark):
    df = events(spark, *[dict(ts="2024-01-29T00:00:00", name=n) for n in "ccbbaad"])
    assert [r["name"] for r in dicts(ev.event_counts(df, k=2))] == ["a", "b"]


def test_empty_input_gives_zeros(spark):
    df = events(spark)
    assert only(ev.mean_events_per_user(df)) == {"events_per_user": 0.0}
    assert only(ev.photo_summary(df, AS_OF)) == {
        "total_photos": 0, "photos_per_user": 0.0, "from_app": 0, "from_widget": 0}
    assert set(only(ev.scan_summary(df, AS_OF)).values()) == {0}
    assert set(only(ev.session_summary(df, AS_OF)).values()) == {0}
    assert set(only(ev.active_users(df, AS_OF)).values()) == {0}
    assert set(only(ev.country_coverage(df, AS_OF)).values()) == {0}
    assert set(only(ev.feature_usage(df, WEEK)).values()) == {0}
    assert only(ev.table_summary(df))["first_event"] is None
    assert [r["user_count"] for r in dicts(ev.engagement_buckets(df, WEEK))] == [0] * 4
    assert [r["count"] for r in dicts(ev.session_duration_distribution(df, WEEK))] == [0] * 5


def test_unreadable_flags_count_in_neither(spark):
    bags = ['{"feature":"f","enabled":true}', '{"feature":"f","enabled":"no idea"}',
            '{"feature":"f"}', '{"feature":"f","enabled":"off"}']
    df = events(spark, *[dict(ts="2024-01-29T00:00:00", name="feature_toggled", properties=b) for b in bags])
    assert only(ev.feature_toggles(df, WEEK)) == {"feature": "f", "enabled_count": 1, "disabled_count": 1}


def test_feature_usage_drops_other_ranges(spark):
    def scan(label):
        return dict(ts="2024-01-29T00:00:00", name="scan_started", properties=f'{{"date_range":"{label}"}}')

    done = dict(ts="2024-01-29T00:00:00", name="scan_completed", properties='{"photos_scanned":"x"}')
    row = only(ev.feature_usage(events(spark, scan("7days"), scan("odd"), done), WEEK))
    assert (row["scans_total"], row["scans_7days"], row["photos_scanned"]) == (2, 1, 0)


def test_bad_values_are_counted(spark):
    df = events(spark, *[dict(ts="2024-01-29T00:00:00", properties=b)
                         for b in ('{"n":1}', '{"n":"x"}', "{}", '{"n":null}')])
    assert only(ev.uncastable_properties(df, {"n": as_int(prop("n"))})) == {"property": "n", "bad_values": 1}


def test_mean_duration_uses_rows_that_have_one(spark):
    bags = ['{"duration_ms":100,"photos_scanned":10,"photos_classified":3}', '{"photos_scanned":5}']
    df = events(spark, *[dict(ts="2024-01-29T00:00:00", name="scan_completed", properties=b) for b in bags],
                dict(ts="2024-01-29T00:00:00", name="scan_started"))
    row = only(ev.scan_summary(df, AS_OF))
    assert row["avg_duration_ms"] == 100.0 and row["completion_rate"] == 200.0
    assert row["photos_per_scan"] == 8.0 and row["spam_rate"] == 20.0 and row["scans_per_user"] == 1.0


def test_active_users(spark):
    df = events(spark, dict(ts="2024-01-30T01:00:00", device_id="new"),
                dict(ts="2024-01-30T01:00:00", device_id="back"), dict(ts="2024-01-29T23:59:59", device_id="back"),
                dict(ts="2024-01-29T00:00:00", device_id="y"), dict(ts="2024-01-29T00:00:00", device_id="z"),
                dict(ts="2024-01-23T00:00:00", device_id="w"), dict(ts="2023-12-31T00:00:00", device_id="m"),
                dict(ts="2023-12-30T23:59:59", device_id="old"))
    row = only(ev.active_users(df, AS_OF))
    assert row == {"dau": 2, "dau_yesterday": 3, "dau_change": -33.3, "wau": 5, "mau": 6, "total_users": 7,
                   "total_events": 8, "events_today": 2, "new_users_today": 1, "avg_events_per_user": 1.2}
    assert only(ev.new_users_since(df, at("2024-01-30"))) == {"new_users": 1}


def test_locale_country_is_not_the_country_column(spark):
    df = events(spark, dict(ts="2024-01-29T00:00:00", locale="en_US", country="FR"),
                dict(ts="2024-01-29T00:00:00", locale="de", country="FR", device_id="d2"))
    got = dicts(ev.dimension_breakdown(df, "locale_country", WEEK))
    assert [(r["locale_country"], r["users"]) for r in got] == [("US", 1), ("de", 1)]


def test_session_buckets(spark):
    sessions = {"a": 1, "b": 5, "c": 6, "d": 11, "e": 10}
    rows = [dict(ts="2024-01-29T00:00:00", device_id=d, session_id=f"{d}{i}")
            for d, n in sessions.items() for i in range(n)]
    rows.append(dict(ts="2024-01-29T00:00:00", device_id="none"))
    assert [r["user_count"] for r in dicts(ev.engagement_buckets(events(spark, *rows), WEEK))] == [1, 1, 2, 1]


def test_session_lengths(spark):
    seconds = {"a": 0, "b": 30, "c": 60, "d": 299, "e": 300, "f": 900}
    rows = []
    for s, n in seconds.items():
        rows.append(dict(ts="2024-01-29T00:00:00", session_id=s))
        rows.append(dict(ts=f"2024-01-29T00:{n // 60:02d}:{n % 60:02d}", session_id=s))
    got = dicts(ev.session_duration_distribution(events(spark, *rows), WEEK))
    assert [r["count"] for r in got] == [1, 1, 2, 1, 1]
    assert got[0]["mean_seconds"] == pytest.approx(sum(seconds.values()) / 6, abs=0.001)


def test_rollup_replaces_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "stats")
    df = events(spark, dict(ts="2024-01-01T00:00:00", name="purchase_completed", properties='{"revenue":1.5}'),
                dict(ts="2024-01-01T01:00:00", name="purchase_completed", properties='{"revenue":"bad"}'),
                dict(ts="2024-01-02T00:00:00", device_id="d2"))
    days = spark.sql("SELECT DATE '2024-01-01' AS date UNION ALL SELECT DATE '2024-01-05'")
    stats = rollup.rollup_daily_stats(df, days)
    by_day = {str(r["date"]): r for r in dicts(stats)}
    assert by_day.keys() == {"2024-01-01", "2024-01-05"}
    assert str(by_day["2024-01-01"]["revenue"]) == "1.50" and by_day["2024-01-01"]["purchases"] == 2
    assert by_day["2024-01-05"]["total_events"] == 0
    rollup.write_daily_stats(rollup.rollup_daily_stats(df), path)
    assert "updated_at" in spark.read.parquet(path).columns

    def kept():
        return sorted(map(str, dicts(spark.read.parquet(path).drop("updated_at"))))

    before = kept()
    rollup.write_daily_stats(rollup.rollup_daily_stats(df, days.limit(1)), path)
    assert kept() == before
