"""Registered user lists, drill-downs, funnels and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.events import RANGE, RANGE_SQL, share
from catalog.registry import query
from catalog.views import AS_OF
from tallyroom import clock
from tallyroom.operators import feeds, funnels, profiles, retention, users

E = "app_events"
E_S = "app_events subscription_events"

# The device's stats over events that meet a condition.
STATS = """device_id, max(user_id) AS user_id, min(event_ts) AS first_seen, max(event_ts) AS last_active,
  count(*) AS total_events, count(DISTINCT session_id) AS total_sessions,
  count(DISTINCT CAST(event_ts AS DATE)) AS active_days, max(platform) AS platform,
  max(os_version) AS os_version, max(device_model) AS device_model, max(app_version) AS app_version,
  max(locale) AS locale, max(timezone) AS timezone"""

query(
    "user_stats", lambda t: users.user_stats(t.app_events, RANGE), E,
    f"SELECT {STATS} FROM app_events WHERE {RANGE_SQL} GROUP BY device_id",
)

LIST = f"""WITH stats AS (SELECT {STATS},
    count(*) FILTER (name = 'purchase_completed') AS purchase_count,
    CAST(COALESCE(sum(TRY_CAST(properties->>'$.revenue' AS DECIMAL(18,2))) FILTER (name = 'purchase_completed'), 0) AS DOUBLE) AS total_revenue,
    count(*) FILTER (name = 'photo_captured') AS photos_captured
  FROM app_events WHERE {RANGE_SQL} GROUP BY device_id),
  listed AS (SELECT *, CASE WHEN purchase_count > 0 THEN 'subscriber'
    WHEN last_active >= TIMESTAMP '2024-01-23 23:59:59' THEN 'active'
    WHEN last_active < TIMESTAMP '2023-12-31 23:59:59' THEN 'churned' ELSE 'inactive' END AS user_status
  FROM stats)
"""
BOUGHT = "SELECT device_id FROM app_events WHERE name = 'purchase_completed'"
SUBSCRIBED = "SELECT device_id FROM app_events WHERE name = 'subscription_started' AND properties->>'$.tier' ="

# Options of ``user_list`` and the equivalent condition and order.
LISTS = {
    "user_list": (dict(limit=50, offset=10), "TRUE", "last_active DESC", "LIMIT 50 OFFSET 10"),
    "user_list_purchasers": (
        dict(filter="purchasers", sort="purchases", limit=500),
        f"device_id IN ({BOUGHT})", "purchase_count DESC", "LIMIT 500"),
    "user_list_active": (
        dict(filter="active", sort="events", limit=40),
        "last_active >= TIMESTAMP '2024-01-23 23:59:59'", "total_events DESC", "LIMIT 40"),
    "user_list_retained": (
        dict(filter="retained", sort="first_seen", order="asc", limit=60),
        """device_id IN (SELECT device_id FROM app_events GROUP BY device_id
        HAVING max(event_ts) >= min(event_ts) + INTERVAL 7 DAY)""", "first_seen", "LIMIT 60"),
    "user_list_country": (
        dict(country="FR", limit=500),
        "device_id IN (SELECT device_id FROM app_events WHERE country = 'FR')",
        "last_active DESC", "LIMIT 500"),
    "user_list_free_tier": (
        dict(tier="Free", limit=500), f"device_id NOT IN ({BOUGHT})", "last_active DESC", "LIMIT 500"),
    "user_list_paid_tier": (
        dict(tier="max", limit=500), f"device_id IN ({SUBSCRIBED} 'max')",
        "last_active DESC", "LIMIT 500"),
    "user_list_plan": (
        dict(plan="Pro Yearly", filter="purchasers", limit=500),
        f"""device_id IN ({SUBSCRIBED} 'pro' AND properties->>'$.billing_period' = 'yearly')
        AND device_id IN ({BOUGHT})""", "last_active DESC", "LIMIT 500"),
    "user_list_device_language_os": (
        dict(device="iphone1", language="FR", os="7.", search="D1", limit=500),
        """device_model ILIKE '%iphone1%' AND locale ILIKE 'FR%' AND os_version ILIKE '%7.%'
        AND (device_id ILIKE '%D1%' OR user_id ILIKE '%D1%')""", "last_active DESC", "LIMIT 500"),
}


def _list(t, options):
    page = users.user_list(t.app_events, RANGE, as_of=AS_OF, **options)
    return page._replace(rows=page.rows.withColumn("total_revenue", F.col("total_revenue").cast("double")))


for name, (options, condition, order, limit) in LISTS.items():
    query(
        name, lambda t, o=options: _list(t, o).rows, E,
        f"{LIST} SELECT * FROM listed WHERE {condition} ORDER BY {order}, device_id {limit}",
    )
# Seen from a month later, devices quiet since 2024-01-26 are gone.
LATER = datetime(2024, 2, 25, 23, 59, 59)
LATER_LIST = LIST.replace("2023-12-31 23:59:59", "2024-01-26 23:59:59").replace(
    "2024-01-23 23:59:59", "2024-02-18 23:59:59"
)
query(
    "user_list_churned",
    lambda t: users.user_list(t.app_events, RANGE, filter="churned", as_of=LATER).rows
    .withColumn("total_revenue", F.col("total_revenue").cast("double")), E,
    f"""{LATER_LIST} SELECT * FROM listed WHERE last_active < TIMESTAMP '2024-01-26 23:59:59'
    ORDER BY last_active DESC, device_id LIMIT 50""",
)
query(
    "user_list_total", lambda t: _list(t, LISTS["user_list_plan"][0]).total, E,
    f"{LIST} SELECT count(*) AS total FROM listed WHERE {LISTS['user_list_plan'][1]}",
)

DETAIL = f"""WITH s AS (SELECT {STATS}, max(session_duration_seconds)::BIGINT AS max_session_duration
    FROM app_events GROUP BY device_id),
  d AS (SELECT *,
    CAST(floor((epoch_us(TIMESTAMP '2024-01-30 23:59:59') - epoch_us(first_seen)) / 86400000000.0) AS BIGINT) AS days_since_install,
    CAST(floor((epoch_us(TIMESTAMP '2024-01-30 23:59:59') - epoch_us(last_active)) / 86400000000.0) AS BIGINT) AS days_inactive
    FROM s),
  paying AS (SELECT app_user_id AS id FROM subscription_events WHERE event_type IN ('INITIAL_PURCHASE', 'RENEWAL')
    UNION SELECT original_app_user_id FROM subscription_events WHERE event_type IN ('INITIAL_PURCHASE', 'RENEWAL'))
  SELECT d.*, CASE WHEN device_id IN (SELECT id FROM paying) THEN 'subscriber'
      WHEN days_inactive <= 7 THEN 'active' WHEN days_inactive > 30 THEN 'churned' ELSE 'inactive' END AS status,
    p.email AS profile_email, p.phone AS profile_phone, p.subscription_tier AS profile_subscription_tier,
    p.opted_in_marketing AS profile_opted_in_marketing
  FROM d LEFT JOIN profiles p USING (device_id)"""
query(
    "user_detail",
    lambda t: users.user_detail(t.app_events, t.subscription_events, t.profiles, as_of=AS_OF),
    E_S + " profiles", DETAIL,
)
query(
    "one_user_detail",
    lambda t: users.user_detail(t.app_events, t.subscription_events, t.profiles, "d7", AS_OF),
    E_S + " profiles", DETAIL + " WHERE device_id = 'd7'",
)
query(
    "event_breakdown", lambda t: users.event_breakdown(t.app_events), E,
    "SELECT device_id, name, count(*) AS count FROM app_events GROUP BY 1, 2",
)
query(
    "latest_event_breakdown", lambda t: users.latest_event_breakdown(t.app_events, k=20), E,
    """SELECT device_id, name, count(*) AS count FROM (
      SELECT device_id, name, row_number() OVER (PARTITION BY device_id ORDER BY event_ts DESC, id DESC) AS r
      FROM app_events) WHERE r <= 20 GROUP BY 1, 2""",
)
TIMELINE = """, s AS (SELECT device_id, session_id, min(event_ts) AS started, max(event_ts) AS ended,
    count(*) AS events_count, arg_max(session_duration_seconds, struct_pack(t := event_ts, i := id)) AS reported_duration,
    (epoch_us(max(event_ts)) - epoch_us(min(event_ts))) // 1000 AS duration_ms
  FROM e WHERE session_id IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY started DESC, session_id DESC) AS INT) AS session_rank FROM s)
  SELECT * FROM r WHERE session_rank <="""
query(
    "session_timeline", lambda t: users.session_timeline(t.app_events, k=5), E,
    f"WITH e AS (SELECT * FROM app_events) {TIMELINE} 5",
)
query(
    "session_timeline_of_latest_events",
    lambda t: users.session_timeline(t.app_events, k=20, newest_events=30), E,
    f"""WITH e AS (SELECT * FROM app_events
      QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_ts DESC, id DESC) <= 30) {TIMELINE} 20""",
)


def _by_event(t):
    return users.users_by_event(t.app_events, "scan_started", RANGE, limit=40, offset=5)


query(
    "users_by_event", lambda t: _by_event(t).rows, E,
    f"""WITH u AS (SELECT device_id, count(*) AS event_count, min(event_ts) AS first_occurrence,
      max(event_ts) AS last_occurrence, arg_max(properties, struct_pack(t := event_ts, i := id)) AS last_properties
      FROM app_events WHERE name = 'scan_started' AND {RANGE_SQL} GROUP BY 1),
    s AS (SELECT device_id, min(event_ts) AS first_seen, max(event_ts) AS last_active, count(*) AS total_events
      FROM app_events GROUP BY 1)
    SELECT * FROM u JOIN s USING (device_id) ORDER BY last_occurrence DESC, device_id LIMIT 40 OFFSET 5""",
)
query(
    "users_by_event_total", lambda t: _by_event(t).total, E,
    f"SELECT count(DISTINCT device_id) AS total FROM app_events WHERE name = 'scan_started' AND {RANGE_SQL}",
)
query(
    "funnel_dropoff",
    lambda t: users.funnel_dropoff(t.app_events, "paywall_viewed", "purchase_started", RANGE), E,
    f"""WITH a AS (SELECT DISTINCT device_id FROM app_events WHERE name = 'paywall_viewed' AND {RANGE_SQL}),
    b AS (SELECT DISTINCT device_id FROM app_events WHERE name = 'purchase_started' AND {RANGE_SQL})
    SELECT device_id, min(event_ts) AS first_seen, max(event_ts) AS last_active, count(*) AS total_events
    FROM app_events WHERE device_id IN (SELECT a.device_id FROM a LEFT JOIN b USING (device_id) WHERE b.device_id IS NULL)
    GROUP BY device_id ORDER BY last_active DESC, device_id LIMIT 100""",
)
SINCE_SQL = "event_ts >= TIMESTAMP '2024-01-16 23:59:59'"
query(
    "dropped_devices",
    lambda t: users.dropped_devices(t.app_events, "permission_granted", "first_scan", AS_OF, 14), E,
    f"""SELECT DISTINCT device_id FROM app_events a WHERE name = 'permission_result'
    AND properties->>'$.granted' = 'true' AND {SINCE_SQL} AND NOT EXISTS (
      SELECT 1 FROM app_events b WHERE b.device_id = a.device_id AND b.name = 'scan_started'
      AND b.{SINCE_SQL})""",
)
query(
    "users_at_step", lambda t: users.users_at_step(t.app_events, "permission_granted", AS_OF, 14), E,
    f"""SELECT DISTINCT device_id FROM app_events WHERE name = 'permission_result'
    AND properties->>'$.granted' = 'true' AND {SINCE_SQL}""",
)

SEGMENT = """SELECT device_id, min(event_ts) AS first_seen, max(event_ts) AS last_seen,
    count(*) AS events_count, count(DISTINCT session_id) AS sessions_count, max(platform) AS platform,
    max(os_version) AS os_version, max(device_model) AS device_model, max(app_version) AS app_version,
    max(locale) AS locale, max(timezone) AS timezone FROM app_events WHERE {} GROUP BY device_id HAVING {}"""
SEGMENTS = {
    "dau": (dict(segment="dau"), "event_ts >= TIMESTAMP '2024-01-30'", "TRUE"),
    "wau": (dict(segment="wau", event_name="photo_captured"),
            "event_ts >= TIMESTAMP '2024-01-23' AND name = 'photo_captured'", "TRUE"),
    "mau": (dict(segment="mau", sort="events_count"), "event_ts >= TIMESTAMP '2023-12-31'", "TRUE"),
    "new_today": (dict(segment="new_today", date_from="2024-01-28"),
                  "event_ts >= TIMESTAMP '2024-01-28'",
                  "CAST(min(event_ts) AS DATE) = DATE '2024-01-30'"),
    "returning": (dict(segment="returning"), "TRUE",
                  """CAST(min(event_ts) AS DATE) < DATE '2024-01-30'
                  AND CAST(max(event_ts) AS DATE) = DATE '2024-01-30'"""),
    "all": (dict(segment="all", date_from="2024-01-10", date_to="2024-01-12", sort="first_seen", order="asc"),
            "event_ts >= TIMESTAMP '2024-01-10' AND event_ts <= TIMESTAMP '2024-01-12 23:59:59.999'", "TRUE"),
}
ORDERS = {"events_count": "events_count DESC", "first_seen": "first_seen"}
for segment, (options, where, having) in SEGMENTS.items():
    order = ORDERS.get(options.get("sort"), "last_seen DESC")
    body = SEGMENT.format(where, having)
    query(
        f"segment_{segment}",
        lambda t, o=options: users.segment_users(t.app_events, as_of=AS_OF, **o).rows, E,
        f"{body} ORDER BY {order}, device_id LIMIT 100",
    )
query(
    "segment_total",
    lambda t: users.segment_users(t.app_events, as_of=AS_OF, **SEGMENTS["returning"][0]).total, E,
    f"SELECT count(*) AS total FROM ({SEGMENT.format(*SEGMENTS['returning'][1:])})",
)
query(
    "cohort_members", lambda t: users.cohort_members(t.app_events, "2024-01-09"), E,
    """SELECT device_id, min(event_ts) AS first_seen FROM app_events GROUP BY device_id
    HAVING CAST(min(event_ts) AS DATE) = DATE '2024-01-09'""",
)
query(
    "cohort_members_returned", lambda t: users.cohort_members(t.app_events, "2024-01-09", 7), E,
    """WITH c AS (SELECT device_id FROM app_events GROUP BY device_id
      HAVING CAST(min(event_ts) AS DATE) = DATE '2024-01-09')
    SELECT device_id, device_id IN (SELECT device_id FROM app_events
      WHERE CAST(event_ts AS DATE) = DATE '2024-01-16') AS returned FROM c""",
)

# Profiles and purchases of single users.

query(
    "profile_lookup", lambda t: feeds.profile_lookup(t.profiles, "d42"), "profiles",
    "SELECT * FROM profiles WHERE device_id = 'd42'",
)
query(
    "user_purchase_history",
    lambda t: feeds.user_purchase_history(t.subscription_events, "d8")
    .withColumn("price", F.col("price").cast("double")), "subscription_events",
    """SELECT event_type, product_id, CAST(price AS DOUBLE) AS price, currency, period_type,
    is_trial_conversion, created_at
    FROM subscription_events WHERE app_user_id = 'd8' OR original_app_user_id = 'd8'""",
)
query(
    "subscriber_overview", lambda t: profiles.subscriber_overview(t.profiles), "profiles",
    """SELECT count(*) AS total_profiles, count(email) AS with_email, count(phone) AS with_phone,
    count(*) FILTER (opted_in_marketing) AS marketing_opt_in FROM profiles""",
)
query(
    "subscribers_by_tier", lambda t: profiles.subscribers_by_tier(t.profiles), "profiles",
    """SELECT subscription_tier, count(*) AS count FROM profiles
    WHERE subscription_tier IS NOT NULL GROUP BY 1""",
)

# Funnels.

STEPS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(funnels.PURCHASE_STEPS, 1))
query(
    "funnel", lambda t: funnels.funnel(t.app_events, RANGE), E,
    f"""WITH steps(step_no, step) AS (VALUES {STEPS}),
    c AS (SELECT step_no, step, count(DISTINCT device_id) AS users FROM steps
      LEFT JOIN (SELECT * FROM app_events WHERE {RANGE_SQL}) ON name = step GROUP BY 1, 2),
    p AS (SELECT *, lag(users) OVER (ORDER BY step_no) AS before FROM c)
    SELECT step_no, step, users,
      CASE WHEN step_no = 1 THEN 100.0::DOUBLE ELSE {share('users', 'before', 2)} END AS conversion_rate FROM p""",
)
STAGES = ", ".join(f"({i}, '{s.label}', '{s.event}')" for i, s in enumerate(funnels.SUBSCRIPTION_STAGES, 1))
query(
    "staged_funnel", lambda t: funnels.staged_funnel(t.app_events, as_of=AS_OF, days=14), E,
    f"""WITH stages(stage_no, stage, event) AS (VALUES {STAGES}),
    c AS (SELECT stage_no, stage, count(DISTINCT device_id) AS users FROM stages
      LEFT JOIN (SELECT * FROM app_events WHERE event_ts >= TIMESTAMP '2024-01-16') ON name = event
        AND (stage <> 'Permission Granted' OR properties->>'$.granted' = 'true') GROUP BY 1, 2),
    p AS (SELECT *, COALESCE(last_value(NULLIF(users, 0) IGNORE NULLS) OVER (ORDER BY stage_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      first_value(users) OVER (ORDER BY stage_no) AS top,
      last_value(users) OVER (ORDER BY stage_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS bottom FROM c)
    SELECT stage_no, stage, users, {share('users', 'before', 1, '100.0')} AS conversion,
      {share('before - users', 'before', 1)} AS drop_off, {share('bottom', 'top', 2)} AS overall_conversion FROM p""",
)

# Retention.

def daily_cohorts_sql(condition: str) -> str:
    return f"""WITH f AS (SELECT device_id, CAST(min(event_ts) AS DATE) AS cohort_date FROM app_events
      WHERE {condition} GROUP BY 1),
    a AS (SELECT device_id, cohort_date, CAST(event_ts AS DATE) - cohort_date AS n
      FROM app_events JOIN f USING (device_id) WHERE {condition}),
    c AS (SELECT cohort_date, count(DISTINCT device_id) AS cohort_size,
      count(DISTINCT device_id) FILTER (n = 1) AS d1_retained, count(DISTINCT device_id) FILTER (n = 7) AS d7_retained,
      count(DISTINCT device_id) FILTER (n = 30) AS d30_retained
      FROM a GROUP BY 1 ORDER BY 1 DESC LIMIT 14)
    SELECT *, {share('d1_retained', 'cohort_size', 1)} AS d1_rate, {share('d7_retained', 'cohort_size', 1)} AS d7_rate,
      {share('d30_retained', 'cohort_size', 1)} AS d30_rate FROM c"""


query(
    "daily_cohort_retention", lambda t: retention.daily_cohort_retention(t.app_events, RANGE), E,
    daily_cohorts_sql(RANGE_SQL),
)
query(
    "daily_cohort_retention_70_days",
    lambda t: retention.daily_cohort_retention(t.app_events, clock.date_range(AS_OF, 70)), E,
    daily_cohorts_sql(
        "event_ts >= TIMESTAMP '2023-11-21 00:00:00' AND event_ts <= TIMESTAMP '2024-01-30 23:59:59'"
    ),
)
query(
    "overall_retention", lambda t: retention.overall_retention(t.app_events, RANGE), E,
    f"""WITH f AS (SELECT device_id, max(CAST(event_ts AS DATE)) - min(CAST(event_ts AS DATE)) AS n
      FROM app_events WHERE {RANGE_SQL} GROUP BY 1),
    c AS (SELECT count(*) AS total_users, count(*) FILTER (n >= 1) AS d1_retained,
      count(*) FILTER (n >= 7) AS d7_retained, count(*) FILTER (n >= 30) AS d30_retained FROM f)
    SELECT *, {share('d1_retained', 'total_users', 1)} AS d1_retention,
      {share('d7_retained', 'total_users', 1)} AS d7_retention,
      {share('d30_retained', 'total_users', 1)} AS d30_retention FROM c""",
)
KEPT = ",\n".join(
    f"""CASE WHEN cohort_end + {p} > DATE '2024-01-30' OR cohort_size = 0 THEN NULL ELSE
      (SELECT count(DISTINCT a.device_id) FROM app_events a JOIN f USING (device_id)
       WHERE f.first_day >= cohort_start AND f.first_day < cohort_end
       AND CAST(a.event_ts AS DATE) = cohort_end + {p - 1})::DOUBLE / cohort_size::DOUBLE * 100 END AS day{p}"""
    for p in retention.WEEKLY_PERIODS
)
query(
    "weekly_cohort_retention", lambda t: retention.weekly_cohort_retention(t.app_events, AS_OF), E,
    f"""WITH f AS (SELECT device_id, CAST(min(event_ts) AS DATE) AS first_day FROM app_events GROUP BY 1),
    w(week) AS (VALUES (1), (2), (3), (4)),
    b AS (SELECT week, DATE '2024-01-30' - 7 * week AS cohort_start, DATE '2024-01-30' - 7 * (week - 1) AS cohort_end FROM w),
    c AS (SELECT b.*, (SELECT count(*) FROM f WHERE first_day >= cohort_start AND first_day < cohort_end) AS cohort_size FROM b)
    SELECT week, cohort_start, cohort_size, {KEPT} FROM c""",
)
