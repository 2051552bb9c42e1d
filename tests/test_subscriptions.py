from __future__ import annotations

from datetime import date
from decimal import Decimal

from build import AS_OF, at, dicts, events, only, subscriptions

from tallyroom import clock
from tallyroom.operators import events as ev, feeds, subscriptions as subs

MONTH = clock.date_range(AS_OF, 30)
D = Decimal


def test_mrr_takes_the_first_matching_period(spark):
    df = subscriptions(
        spark,
        dict(ts="2024-01-20T00:00:00", period_type="MONTHLY", product_id="x_yearly", price=D("10.00")),
        dict(ts="2024-01-20T00:00:00", product_id="pro_monthly", price=D("10.00"), takehome_percentage=D("85.00")),
        dict(ts="2024-01-20T00:00:00", product_id="pro_yearly", price=D("120.00"), app_user_id="u2"),
        dict(ts="2024-01-20T00:00:00", product_id="PRO_MONTHLY", price=D("99.00")),
        dict(ts="2024-01-20T00:00:00", price=D("99.00"), event_type="RENEWAL", app_user_id=None),
        dict(ts="2024-01-20T00:00:00", product_id="pro_monthly", price=D("99.00"), environment="SANDBOX"),
        dict(ts="2023-12-30T00:00:00", product_id="pro_monthly", price=D("99.00")),
        dict(ts="2024-01-20T00:00:00", product_id="pro_monthly", price=D("99.00"), event_type="CANCELLATION"),
    )
    assert only(subs.mrr(df, AS_OF)) == {"mrr": 7.0 + 8.5 + 7.0, "active_subscribers": 2}


def test_money_without_rows(spark):
    none, nobody = subscriptions(spark), events(spark)
    assert only(subs.mrr(none, AS_OF)) == {"mrr": 0.0, "active_subscribers": 0}
    row = only(subs.monetization(none, nobody, AS_OF))
    assert row["total_users"] == 1 and row["arpu"] == row["arppu"] == row["ltv"] == 0.0
    assert only(subs.revenue_today(none, AS_OF)) == {"revenue_today": 0.0}
    assert only(subs.purchase_revenue(none, MONTH)) == {"total": 0.0, "purchases": 0}
    assert set(only(subs.production_stats(none)).values()) == {0}
    tiers = dicts(subs.users_by_tier(none, ev.period_totals(nobody, MONTH), MONTH))
    assert [(r["tier"], r["count"]) for r in tiers] == [("free", 0), ("pro", 0), ("max", 0)]


def test_revenue_per_user(spark):
    df = subscriptions(spark, dict(ts="2023-01-01T00:00:00", price=D("10.00")),
                       dict(ts="2024-01-01T00:00:00", price=D("20.00"), app_user_id="u2"))
    seen = events(spark, *[dict(ts="2024-01-29T00:00:00", device_id=f"d{i}") for i in range(4)])
    row = only(subs.monetization(df, seen, AS_OF))
    assert (row["total_revenue"], row["arpu"], row["arppu"], row["ltv"]) == (30.0, 7.5, 15.0, 90.0)


def test_tiers_are_mutually_deducted(spark):
    df = subscriptions(spark, dict(ts="2024-01-20T00:00:00", product_id="MAX_monthly"),
                       dict(ts="2024-01-20T00:00:00", product_id="other", app_user_id="u2"),
                       dict(ts="2024-01-20T00:00:00", product_id=None, app_user_id="u3"))
    seen = events(spark, *[dict(ts="2024-01-29T00:00:00", device_id=f"d{i}") for i in range(5)])
    got = {r["tier"]: r["count"] for r in dicts(subs.users_by_tier(df, ev.period_totals(seen, MONTH), MONTH))}
    assert got == {"free": 2, "pro": 2, "max": 1}
    few = dicts(subs.users_by_tier(df, ev.period_totals(seen.limit(1), MONTH), MONTH))
    assert few[0]["count"] == 0


def test_trends(spark):
    df = subscriptions(spark, dict(ts="2024-01-20T00:00:00", price=D("5.00")),
                       dict(ts="2024-01-20T01:00:00", price=D("5.00")),
                       dict(ts="2024-01-21T00:00:00", price=D("9.00"), event_type="RENEWAL"),
                       dict(ts="2024-01-22T00:00:00", event_type="EXPIRATION", environment="SANDBOX"))
    assert [(r["date"], r["revenue"]) for r in dicts(subs.revenue_trend(df, AS_OF))] == [
        (date(2024, 1, 20), 10.0), (date(2024, 1, 21), 0.0)]
    assert only(subs.subscriber_trend(df, AS_OF)) == {"date": date(2024, 1, 20), "new_subscribers": 1}
    assert only(subs.churn_by_day(df, AS_OF)) == {"date": date(2024, 1, 22), "churn_count": 1}


def test_plans_without_a_price_come_first(spark):
    df = subscriptions(spark, dict(ts="2024-01-20T00:00:00", product_id="a", price=D("5.00")),
                       dict(ts="2024-01-20T00:00:00", product_id="b"),
                       dict(ts="2024-01-20T00:00:00", product_id="c", price=D("7.00")))
    assert [r["product_id"] for r in dicts(subs.revenue_by_plan(df))] == ["b", "c", "a"]


def test_feed_shows_every_environment(spark):
    df = subscriptions(spark, dict(ts="2024-01-20T00:00:00", environment="SANDBOX"), dict(ts="2024-01-21T00:00:00"))
    got = dicts(feeds.recent_subscription_events(df, AS_OF))
    assert [r["environment"] for r in got] == ["PRODUCTION", "SANDBOX"]


def test_today_starts_at_midnight(spark):
    df = subscriptions(spark, dict(ts="2024-01-30T00:00:00", price=D("1.25")),
                       dict(ts="2024-01-29T23:59:59", price=D("9.00")))
    assert only(subs.revenue_today(df, AS_OF)) == {"revenue_today": 1.25}
    assert at("2024-01-30") == clock.since_midnight(AS_OF, 0).lo
