from __future__ import annotations

import pytest
from build import AS_OF, at, dicts, events, only, profiles, subscriptions

from tallyroom import clock
from tallyroom.operators import feeds, funnels, retention, users

MONTH = clock.date_range(AS_OF, 30)


def test_one_row_per_device_whatever_the_user_ids(spark):
    df = events(spark, dict(ts="2024-01-29T00:00:00", user_id="a", session_id="s"),
                dict(ts="2024-01-30T00:00:00", user_id="b", session_id="s", locale="en"),
                dict(ts="2024-01-30T01:00:00"))
    row = only(users.user_stats(df))
    assert (row["user_id"], row["total_sessions"], row["active_days"], row["total_events"]) == ("b", 1, 2, 3)


@pytest.fixture(scope="module")
def people(spark):
    return events(
        spark,
        dict(ts="2024-01-29T00:00:00", device_id="buyer", name="purchase_completed", user_id="Ann",
             properties='{"revenue":9.99}', device_model="iPhone12", locale="en_US", os_version="17.1"),
        dict(ts="2024-01-29T00:00:00", device_id="fresh", name="photo_captured", country="FR", locale="fr_FR"),
        dict(ts="2024-01-05T00:00:00", device_id="quiet"),
        dict(ts="2023-12-31T00:00:00", device_id="gone_100%"),
        dict(ts="2023-06-01T00:00:00", device_id="quiet", name="subscription_started",
             properties='{"tier":"pro","billing_period":"yearly"}'),
        dict(ts="2024-01-20T00:00:00", device_id="fresh"),
        dict(ts="2022-01-01T00:00:00", device_id="ancient", name="purchase_completed"),
    )


def listed(people, **options):
    options.setdefault("as_of", at("2024-01-30T12:00:00"))
    return [r["device_id"] for r in dicts(users.user_list(people, MONTH, **options).rows)]


def test_statuses(people):
    page = users.user_list(people, MONTH, as_of=AS_OF)
    assert {r["device_id"]: r["user_status"] for r in dicts(page.rows)} == {
        "buyer": "subscriber", "fresh": "active", "quiet": "inactive", "gone_100%": "churned"}
    assert only(page.total) == {"total": 4}
    buyer = next(r for r in dicts(page.rows) if r["device_id"] == "buyer")
    assert str(buyer["total_revenue"]) == "9.99" and buyer["photos_captured"] == 0


def test_filters(people):
    assert listed(people, filter="purchasers") == ["buyer"]
    assert sorted(listed(people, filter="active")) == ["buyer", "fresh"]
    assert listed(people, filter="churned") == ["gone_100%"]
    # Seven days between first and last event of all time, not of the window.
    assert sorted(listed(people, filter="retained")) == ["fresh", "quiet"]
    assert listed(people, country="FR") == ["fresh"]
    assert sorted(listed(people, tier="free")) == ["fresh", "gone_100%", "quiet"]
    assert listed(people, tier="PRO") == ["quiet"]
    assert listed(people, plan="Pro Yearly") == ["quiet"]
    assert listed(people, plan="Pro Monthly") == []
    assert listed(people, device="IPHONE", language="EN", os="7.") == ["buyer"]
    assert listed(people, search="ANN") == ["buyer"]
    assert listed(people, search="0%") == ["gone_100%"]
    assert listed(people, search="_1") == ["gone_100%"]
    assert listed(people, filter="purchasers", tier="free") == []
    with pytest.raises(ValueError):
        listed(people, filter="nobody")


def test_sorting_and_paging(people):
    assert listed(people, sort="first_seen", order="asc", limit=2, offset=1) == ["quiet", "fresh"]
    assert listed(people, sort="no such column", limit=1) == ["buyer"]


def test_detail_of_subscribers_by_either_id(spark):
    df = events(spark, *[dict(ts="2024-01-20T13:00:00", device_id=d, session_duration_seconds=n)
                         for n, d in enumerate(["a", "b", "c"])])
    subs = subscriptions(spark, dict(ts="2024-01-01T00:00:00", app_user_id="x", original_app_user_id="a"),
                         dict(ts="2024-01-01T00:00:00", app_user_id="b", event_type="CANCELLATION"))
    known = profiles(spark, dict(device_id="c", email="c@example.com"))
    got = {r["device_id"]: r for r in dicts(users.user_detail(df, subs, known, as_of=AS_OF))}
    assert {d: r["status"] for d, r in got.items()} == {"a": "subscriber", "b": "inactive", "c": "inactive"}
    assert got["c"]["profile_email"] == "c@example.com" and got["a"]["profile_email"] is None
    assert got["c"]["days_since_install"] == 9 and got["c"]["max_session_duration"] == 2
    assert [r["device_id"] for r in dicts(users.user_detail(df, subs, known, "b", AS_OF))] == ["b"]


def test_breakdown_of_the_latest_events(spark):
    df = events(spark, *[dict(ts=f"2024-01-{i:02d}T00:00:00", name="old" if i < 10 else "new") for i in range(1, 15)])
    got = {r["name"]: r["count"] for r in dicts(users.latest_event_breakdown(df, k=6))}
    assert got == {"new": 5, "old": 1}
    assert {r["name"]: r["count"] for r in dicts(users.event_breakdown(df))} == {"old": 9, "new": 5}


def test_timeline(spark):
    df = events(spark, dict(ts="2024-01-01T00:00:00", session_id="s1", session_duration_seconds=5),
                dict(ts="2024-01-01T00:01:30.250", session_id="s1", session_duration_seconds=9),
                dict(ts="2024-01-02T00:00:00", session_id="s2"), dict(ts="2024-01-03T00:00:00"))
    got = dicts(users.session_timeline(df))
    s1 = next(r for r in got if r["session_id"] == "s1")
    assert len(got) == 2 and s1["session_rank"] == 2
    assert (s1["duration_ms"], s1["reported_duration"], s1["events_count"]) == (90250, 9, 2)
    assert [r["session_id"] for r in dicts(users.session_timeline(df, k=1))] == ["s2"]
    assert [r["session_id"] for r in dicts(users.session_timeline(df, newest_events=2))] == ["s2"]


def test_users_by_event_looks_beyond_the_window_for_history(spark):
    df = events(spark, dict(ts="2024-01-10T00:00:00", name="x", properties='{"n":1}'),
                dict(ts="2024-01-11T00:00:00", name="x", properties='{"n":2}'),
                dict(ts="2023-01-01T00:00:00", name="x"), dict(ts="2024-01-12T00:00:00", name="y"),
                dict(ts="2024-01-11T00:00:00", name="x", device_id="d0"))
    for limit in (5, users.PAGE_BROADCAST_ROWS + 1):
        page = users.users_by_event(df, "x", MONTH, limit=limit)
        rows = {r["device_id"]: r for r in dicts(page.rows)}
        assert rows.keys() == {"d0", "d1"} and only(page.total) == {"total": 2}
        row = rows["d1"]
        assert (row["event_count"], row["total_events"], row["last_properties"]) == (2, 4, '{"n":2}')
        assert row["first_seen"] == at("2023-01-01")
    assert [r["device_id"] for r in dicts(users.users_by_event(df, "x", MONTH, 1, 1).rows)] == ["d1"]


def test_dropoff_and_completion_partition_the_step(spark):
    df = events(spark, dict(ts="2024-01-10T00:00:00", name="a", device_id="1"),
                dict(ts="2024-01-10T00:00:00", name="a", device_id="2"),
                dict(ts="2024-01-09T00:00:00", name="b", device_id="2"),
                dict(ts="2023-01-09T00:00:00", name="b", device_id="1"),
                dict(ts="2024-01-10T00:00:00", name="b", device_id="3"))
    lost = dicts(users.funnel_dropoff(df, "a", "b", MONTH))
    assert [(r["device_id"], r["total_events"]) for r in lost] == [("1", 2)]
    assert [r["device_id"] for r in dicts(users.dropped_devices(df, "a", "b", AS_OF))] == ["1"]
    kept = df.filter("name = 'a'").join(df.filter("name = 'b' AND event_ts > '2024-01-01'"), "device_id", "left_semi")
    step = {r["device_id"] for r in dicts(users.users_at_step(df, "a", AS_OF))}
    assert step == {"1"} | {r["device_id"] for r in dicts(kept)}


def test_permission_step_needs_the_grant(spark):
    df = events(spark, dict(ts="2024-01-29T00:00:00", name="permission_result", device_id="y", properties='{"granted":"true"}'),
                dict(ts="2024-01-29T00:00:00", name="permission_result", device_id="n", properties='{"granted":"false"}'),
                dict(ts="2024-01-29T00:00:00", name="permission_result", device_id="b", properties='{"granted":true}'))
    got = {r["device_id"] for r in dicts(users.users_at_step(df, "permission_granted", AS_OF))}
    assert got == {"y", "b"}


def test_segments(spark):
    df = events(spark, dict(ts="2024-01-30T01:00:00", device_id="new"),
                dict(ts="2024-01-30T01:00:00", device_id="back"), dict(ts="2024-01-02T00:00:00", device_id="back", name="x"),
                dict(ts="2024-01-25T00:00:00", device_id="week"), dict(ts="2023-01-01T00:00:00", device_id="old"))

    def ids(segment, **options):
        page = users.segment_users(df, segment, as_of=AS_OF, **options)
        rows = [r["device_id"] for r in dicts(page.rows)]
        assert only(page.total)["total"] >= len(rows)
        return rows

    assert ids("dau") == ["back", "new"] and ids("wau") == ["back", "new", "week"]
    assert ids("mau", sort="events_count") == ["back", "new", "week"]
    assert ids("new_today") == ["new"] and ids("returning") == ["back"]
    assert len(ids("all")) == 4 and ids("all", limit=1, offset=3) == ["old"]
    # The date filter comes before the first activity is taken.
    assert sorted(ids("new_today", date_from="2024-01-30")) == ["back", "new"]
    assert ids("all", event_name="x") == ["back"]
    with pytest.raises(ValueError):
        ids("some")


def test_cohorts(spark):
    df = events(spark, dict(ts="2024-01-02T23:00:00", device_id="a"), dict(ts="2024-01-03T00:00:00", device_id="a"),
                dict(ts="2024-01-02T00:00:00", device_id="b"), dict(ts="2024-01-01T00:00:00", device_id="c"),
                dict(ts="2024-01-02T00:00:00", device_id="c"))
    assert {r["device_id"] for r in dicts(users.cohort_members(df, "2024-01-02"))} == {"a", "b"}
    got = {r["device_id"]: r["returned"] for r in dicts(users.cohort_members(df, "2024-01-02", 1))}
    assert got == {"a": True, "b": False}


def test_histories(spark):
    df = events(spark, *[dict(ts=f"2024-01-0{i}T00:00:00", device_id=f"d{i % 2}") for i in range(1, 8)])
    assert [r["id"] for r in dicts(feeds.user_event_history(df, "d1", 2))] == [6, 4]
    subs = subscriptions(spark, dict(ts="2024-01-01T00:00:00", app_user_id="a"),
                         dict(ts="2024-01-02T00:00:00", app_user_id="b", original_app_user_id="a"),
                         dict(ts="2024-01-03T00:00:00", app_user_id="b"))
    assert [r["created_at"].day for r in dicts(feeds.user_purchase_history(subs, "a"))] == [2, 1]


def test_funnel_rates_can_exceed_one_hundred(spark):
    df = events(spark, dict(ts="2024-01-29T00:00:00", name="s1"),
                *[dict(ts="2024-01-29T00:00:00", name="s3", device_id=f"x{i}") for i in range(3)],
                *[dict(ts="2024-01-29T00:00:00", name="s4", device_id=f"x{i}") for i in range(4)])
    got = dicts(funnels.funnel(df, MONTH, ["s1", "s2", "s3", "s4"]))
    assert [(r["users"], r["conversion_rate"]) for r in got] == [(1, 100.0), (0, 0.0), (3, 0.0), (4, 133.33)]


def test_staged_funnel_carries_the_last_count(spark):
    stages = [funnels.Stage(s, s) for s in ("s1", "s2", "s3", "s4")]
    df = events(spark, *[dict(ts="2024-01-29T00:00:00", name="s1", device_id=f"x{i}") for i in range(4)],
                dict(ts="2024-01-29T00:00:00", name="s3"),
                *[dict(ts="2024-01-29T00:00:00", name="s4", device_id=f"x{i}") for i in range(2)])
    got = dicts(funnels.staged_funnel(df, stages, AS_OF))
    assert [(r["users"], r["conversion"], r["drop_off"]) for r in got] == [
        (4, 100.0, 0.0), (0, 0.0, 100.0), (1, 25.0, 75.0), (2, 200.0, -100.0)]
    assert {r["overall_conversion"] for r in got} == {50.0}
    empty = dicts(funnels.staged_funnel(df.limit(0), stages, AS_OF))
    assert {(r["users"], r["conversion"], r["drop_off"], r["overall_conversion"]) for r in empty} == {(0, 100.0, 0.0, 0.0)}


def test_daily_cohorts_start_inside_the_window(spark):
    df = events(spark, dict(ts="2023-01-01T00:00:00", device_id="a"), dict(ts="2024-01-02T00:00:00", device_id="a"),
                dict(ts="2024-01-03T00:00:00", device_id="a"), dict(ts="2024-01-02T05:00:00", device_id="b"),
                dict(ts="2024-01-09T05:00:00", device_id="b"))
    row = only(retention.daily_cohort_retention(df, MONTH))
    assert str(row["cohort_date"]) == "2024-01-02" and row["cohort_size"] == 2
    assert (row["d1_retained"], row["d7_retained"], row["d30_retained"], row["d1_rate"]) == (1, 1, 0, 50.0)


def test_overall_retention(spark):
    df = events(spark, dict(ts="2024-01-01T00:00:00", device_id="a"), dict(ts="2024-01-09T00:00:00", device_id="a"),
                dict(ts="2024-01-01T00:00:00", device_id="b"), dict(ts="2024-01-02T00:00:00", device_id="b"),
                dict(ts="2024-01-02T00:00:00", device_id="c"))
    row = only(retention.overall_retention(df, MONTH))
    assert (row["total_users"], row["d1_retention"], row["d7_retention"], row["d30_retention"]) == (3, 66.7, 33.3, 0.0)
    assert set(only(retention.overall_retention(df.limit(0), MONTH)).values()) == {0}


def test_weekly_cohorts(spark):
    # Weeks end on the 30th, 23rd, 16th and 9th.
    df = events(spark, dict(ts="2024-01-10T00:00:00", device_id="a"), dict(ts="2024-01-16T00:00:00", device_id="a"),
                dict(ts="2024-01-15T23:59:59", device_id="b"), dict(ts="2024-01-22T10:00:00", device_id="b"),
                dict(ts="2024-01-30T01:00:00", device_id="today"),
                dict(ts="2023-01-01T00:00:00", device_id="old"), dict(ts="2024-01-11T00:00:00", device_id="old"))
    got = dicts(retention.weekly_cohort_retention(df, AS_OF))
    assert [r["week"] for r in got] == [4, 3, 2, 1]
    assert [r["cohort_size"] for r in got] == [0, 2, 0, 0]
    third = got[1]
    assert str(third["cohort_start"]) == "2024-01-09"
    # The day fourteen window ends at midnight of the 30th, before as_of; day thirty is ahead.
    assert (third["day1"], third["day7"], third["day14"], third["day30"]) == (50.0, 50.0, 0.0, None)
    assert all(got[0][f"day{p}"] is None for p in (1, 7, 14, 30))


def test_pages_by_key_follow_pages_by_offset(spark):
    rows = [dict(ts=f"2024-01-{20 + i % 9}T00:00:00", device_id=f"d{i:02}") for i in range(30)]
    df = events(spark, *rows)
    for order in ("desc", "asc"):
        for ask in (lambda **k: users.user_list(df, clock.ALL_TIME, sort="last_active", order=order, as_of=AS_OF, **k),
                    lambda **k: users.segment_users(df, sort="last_seen", order=order, as_of=AS_OF, **k)):
            column = "last_active" if "last_active" in ask(limit=1).rows.columns else "last_seen"
            first = dicts(ask(limit=7).rows)
            second = dicts(ask(limit=7, after=(first[-1][column], first[-1]["device_id"])).rows)
            assert second == dicts(ask(limit=7, offset=7).rows)


def test_search_meets_every_user_id_of_a_device(spark):
    df = events(spark, dict(ts="2024-01-29T00:00:00", user_id="alice"), dict(ts="2024-01-29T01:00:00", user_id="zoe"))
    for text in ("ALICE", "zoe", "d1"):
        assert [r["device_id"] for r in dicts(users.user_list(df, clock.ALL_TIME, search=text, as_of=AS_OF).rows)] == ["d1"]
    assert dicts(users.user_list(df, clock.ALL_TIME, search="bob", as_of=AS_OF).rows) == []


def test_reported_duration_of_equal_times_is_that_of_the_greatest_id(spark):
    df = events(spark, *[dict(ts="2024-01-29T00:00:00", session_id="s", session_duration_seconds=i * 7 % 5) for i in range(8)])
    assert {only(users.session_timeline(df.repartition(n)))["reported_duration"] for n in (1, 3, 8)} == {49 % 5}


def test_user_stats_scans_once_and_reduces_first(spark, tmp_path):
    df = events(spark, dict(ts="2024-01-29T00:00:00"))
    df.write.parquet(str(tmp_path / "e"))
    plan = users.user_stats(spark.read.parquet(str(tmp_path / "e")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert "HashAggregate" in plan[plan.index("Expand"):]
