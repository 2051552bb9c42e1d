"""Registered subscription and revenue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.events import RANGE, RANGE_SQL
from catalog.registry import query
from catalog.views import AS_OF
from tallyroom.functions import conversion_rate
from tallyroom.operators import events as ev, feeds, subscriptions as subs
from tallyroom.plans import join_single_rows

S = "subscription_events"
S_E = "subscription_events app_events"
S_RANGE = RANGE_SQL.replace("event_ts", "created_at")
S_SINCE = "created_at >= TIMESTAMP '2023-12-31 23:59:59'"
FIRST = "environment = 'PRODUCTION' AND event_type = 'INITIAL_PURCHASE'"
PAID = "environment = 'PRODUCTION' AND event_type IN ('INITIAL_PURCHASE', 'RENEWAL')"
MRR = f"""SELECT
    CAST(COALESCE(sum(kept) FILTER (monthly), 0) AS DOUBLE) / 100.0::DOUBLE
      + CAST(COALESCE(sum(kept) FILTER (annual AND NOT monthly), 0) AS DOUBLE) / 1200.0::DOUBLE AS mrr,
    count(DISTINCT app_user_id) AS active_subscribers
  FROM (SELECT app_user_id, price * COALESCE(takehome_percentage, 70) AS kept,
    COALESCE(period_type = 'MONTHLY' OR product_id LIKE '%monthly%', FALSE) AS monthly,
    COALESCE(period_type = 'ANNUAL' OR product_id LIKE '%yearly%', FALSE) AS annual
    FROM subscription_events WHERE {PAID} AND {S_SINCE})"""

query(
    "recent_subscription_events",
    lambda t: feeds.recent_subscription_events(t.subscription_events, AS_OF, 30, 100)
    .withColumn("price", F.col("price").cast("double")), S,
    f"""SELECT event_type, app_user_id, product_id, CAST(price AS DOUBLE) AS price, currency, period_type,
    environment, created_at FROM subscription_events WHERE {S_SINCE}
    ORDER BY created_at DESC, id DESC LIMIT 100""",
)
query(
    "purchase_revenue", lambda t: subs.purchase_revenue(t.subscription_events, RANGE), S,
    f"""SELECT CAST(COALESCE(sum(price), 0) AS DOUBLE) AS total, count(*) AS purchases
    FROM subscription_events WHERE {FIRST} AND {S_RANGE}""",
)
query(
    "users_by_tier",
    lambda t: subs.users_by_tier(
        t.subscription_events, ev.period_totals(t.app_events, RANGE), RANGE
    ), S_E,
    f"""WITH c AS (SELECT count(DISTINCT app_user_id) FILTER (product_id NOT ILIKE '%max%') AS pro,
      count(DISTINCT app_user_id) FILTER (product_id ILIKE '%max%') AS top
      FROM subscription_events WHERE {FIRST} AND {S_RANGE}),
    a AS (SELECT count(DISTINCT device_id) AS active FROM app_events WHERE {RANGE_SQL})
    SELECT 'free' AS tier, greatest(0, active - pro - top) AS count FROM c, a
    UNION ALL SELECT 'pro', pro FROM c UNION ALL SELECT 'max', top FROM c""",
)
query(
    "subscription_event_summary",
    lambda t: subs.subscription_event_summary(t.subscription_events, AS_OF, 30), S,
    f"SELECT event_type, count(*) AS count FROM subscription_events WHERE {S_SINCE} GROUP BY 1",
)
query("mrr", lambda t: subs.mrr(t.subscription_events, AS_OF), S, MRR)
query(
    "churn_by_day", lambda t: subs.churn_by_day(t.subscription_events, AS_OF, 30), S,
    f"""SELECT CAST(created_at AS DATE) AS date, count(*) AS churn_count FROM subscription_events
    WHERE event_type IN ('CANCELLATION', 'EXPIRATION') AND {S_SINCE} GROUP BY 1""",
)
query(
    "production_stats", lambda t: subs.production_stats(t.subscription_events), S,
    f"""SELECT count(DISTINCT app_user_id) FILTER (event_type = 'INITIAL_PURCHASE') AS total_purchases,
    CAST(COALESCE(sum(price) FILTER (event_type = 'INITIAL_PURCHASE'), 0) AS DOUBLE) AS total_revenue,
    count(DISTINCT app_user_id) AS active_subscribers FROM subscription_events WHERE {PAID}""",
)
query(
    "monetization", lambda t: subs.monetization(t.subscription_events, t.app_events, AS_OF, 14), S_E,
    f"""WITH r AS (SELECT CAST(COALESCE(sum(price), 0) AS DOUBLE) AS revenue,
      count(DISTINCT app_user_id) AS payers FROM subscription_events WHERE {FIRST}),
    u AS (SELECT greatest(count(DISTINCT device_id), 1) AS n FROM app_events
      WHERE event_ts >= TIMESTAMP '2024-01-16 23:59:59'),
    m AS ({MRR})
    SELECT revenue AS total_revenue, mrr, revenue / n AS arpu,
      CASE WHEN payers > 0 THEN revenue / payers ELSE 0 END AS arppu,
      CASE WHEN payers > 0 THEN revenue / payers ELSE 0 END * 6 AS ltv,
      payers AS paying_users, n AS total_users, active_subscribers FROM r, u, m""",
)
query(
    "revenue_trend", lambda t: subs.revenue_trend(t.subscription_events, AS_OF, 30), S,
    f"""SELECT CAST(created_at AS DATE) AS date,
    CAST(sum(CASE WHEN event_type = 'INITIAL_PURCHASE' THEN price ELSE 0 END) AS DOUBLE) AS revenue
    FROM subscription_events WHERE environment = 'PRODUCTION' AND {S_SINCE} GROUP BY 1""",
)
query(
    "revenue_by_plan", lambda t: subs.revenue_by_plan(t.subscription_events), S,
    f"""SELECT product_id, count(*) AS purchases, CAST(sum(price) AS DOUBLE) AS revenue
    FROM subscription_events WHERE {FIRST} GROUP BY 1""",
)
query(
    "subscriber_trend", lambda t: subs.subscriber_trend(t.subscription_events, AS_OF, 30), S,
    f"""SELECT CAST(created_at AS DATE) AS date, count(DISTINCT app_user_id) AS new_subscribers
    FROM subscription_events WHERE {FIRST} AND {S_SINCE} GROUP BY 1""",
)
query(
    "revenue_today", lambda t: subs.revenue_today(t.subscription_events, AS_OF), S,
    """SELECT CAST(COALESCE(sum(price), 0) AS DOUBLE) AS revenue_today FROM subscription_events
    WHERE created_at >= TIMESTAMP '2024-01-30'""",
)


def _conversion(t):
    views = ev.event_counts(t.app_events, RANGE).filter("name = 'paywall_viewed'")
    one = join_single_rows(
        subs.purchase_revenue(t.subscription_events, RANGE),
        views.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("paywall_views")),
    )
    return one.select(
        "purchases", "paywall_views",
        conversion_rate(F.col("purchases"), F.col("paywall_views")).alias("conversion_rate"),
    )


query(
    "conversion_rate", _conversion, S_E,
    f"""WITH p AS (SELECT count(*) AS purchases FROM subscription_events WHERE {FIRST} AND {S_RANGE}),
    v AS (SELECT count(*) AS paywall_views FROM app_events WHERE name = 'paywall_viewed' AND {RANGE_SQL})
    SELECT purchases, paywall_views, CASE WHEN paywall_views > 0
      THEN CAST(floor(purchases::DOUBLE / paywall_views::DOUBLE * 100 + 0.5) AS BIGINT) ELSE 0 END AS conversion_rate
    FROM p, v""",
)
