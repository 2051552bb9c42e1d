"""Registered feeds and event aggregations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import AS_OF
from tallyroom import clock
from tallyroom.functions import as_bool, as_int, prop
from tallyroom.operators import events as ev, feeds, rollup, snapshot

E = "app_events"

# 2024-01-10 00:00:00 .. as_of; the same window in SQL.
RANGE = clock.date_range(AS_OF, 20)
RANGE_SQL = "event_ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_ts <= TIMESTAMP '2024-01-30 23:59:59'"
# From midnight 14 days before as_of, and from its time of day.
MIDNIGHT_14 = clock.since_midnight(AS_OF, 14)
MIDNIGHT_14_SQL = "event_ts >= TIMESTAMP '2024-01-16 00:00:00'"
SINCE_14_SQL = "event_ts >= TIMESTAMP '2024-01-16 23:59:59'"

FEED = "name, category, properties, event_ts, created_at, device_id, session_id, platform, os_version, device_model, app_version, locale, timezone, country"
SEARCH = "id, name, category, properties, event_ts, device_id, session_id, platform, os_version, device_model, app_version, locale"


def fixed(value: str, digits: int) -> str:
    """Nearest multiple of 10^-digits, ties away from zero."""
    scale = f"{10 ** digits}.0::DOUBLE"
    return (f"CASE WHEN ({value}) < 0 THEN 0.0::DOUBLE - floor(abs({value}) * {scale} + 0.5) / {scale}"
            f" ELSE floor(abs({value}) * {scale} + 0.5) / {scale} END")


def share(part: str, whole: str, digits: int, empty: str = "0.0") -> str:
    value = f"({part})::DOUBLE / NULLIF({whole}, 0)::DOUBLE * 100"
    return f"CASE WHEN ({whole}) > 0 THEN {fixed(value, digits)} ELSE {empty}::DOUBLE END"


def ratio(part: str, whole: str) -> str:
    return f"COALESCE(({part})::DOUBLE / NULLIF({whole}, 0)::DOUBLE, 0.0::DOUBLE)"


# Feeds.

query(
    "recent_events", lambda t: feeds.recent_events(t.app_events, 50), E,
    f"SELECT {FEED} FROM app_events ORDER BY COALESCE(event_ts, created_at) DESC, id DESC LIMIT 50",
)
query(
    "latest_events", lambda t: feeds.latest_events(t.app_events, 20), E,
    "SELECT name, device_id, event_ts, properties FROM app_events ORDER BY event_ts DESC, id DESC LIMIT 20",
)
query(
    "search_events",
    lambda t: feeds.search_events(
        t.app_events, category="camera", date_from="2024-01-05", date_to="2024-01-20",
        limit=100, offset=30,
    ).rows, E,
    f"""SELECT {SEARCH} FROM app_events WHERE category = 'camera'
    AND event_ts >= TIMESTAMP '2024-01-05 00:00:00' AND event_ts <= TIMESTAMP '2024-01-20 23:59:59.999'
    ORDER BY event_ts DESC, id DESC LIMIT 100 OFFSET 30""",
)


def _by_key(t):
    """Three pages of fifty, each asked for by the last row of the one before."""
    pages, after = [], None
    for _ in range(3):
        page = feeds.search_events(t.app_events, category="camera", limit=50, after=after).rows
        last = page.orderBy("event_ts", "id").first()
        pages.append(page)
        after = (last["event_ts"], last["id"])
    return pages[0].unionAll(pages[1]).unionAll(pages[2])


query(
    "search_events_by_key", _by_key, E,
    f"SELECT {SEARCH} FROM app_events WHERE category = 'camera' ORDER BY event_ts DESC, id DESC LIMIT 150",
)
query(
    "search_events_one_day",
    lambda t: feeds.search_events(
        t.app_events, name="photo_captured", date="2024-01-25", date_from="2024-01-01", limit=200
    ).rows, E,
    f"""SELECT {SEARCH} FROM app_events WHERE name = 'photo_captured'
    AND CAST(event_ts AS DATE) = DATE '2024-01-25' ORDER BY event_ts DESC, id DESC LIMIT 200""",
)
query(
    "search_events_total",
    lambda t: feeds.search_events(
        t.app_events, category="camera", date_from="2024-01-05", date_to="2024-01-20"
    ).total, E,
    """SELECT count(*) AS total FROM app_events WHERE category = 'camera'
    AND event_ts >= TIMESTAMP '2024-01-05 00:00:00' AND event_ts <= TIMESTAMP '2024-01-20 23:59:59.999'""",
)


def _photos_by_source(t):
    return feeds.events_by_property(
        t.app_events, "photo_captured", "source", "app", "app", AS_OF, 14, limit=100, offset=10
    )


def _scans_by_range(t):
    return feeds.events_by_property(
        t.app_events, "scan_started", "date_range", "30days", None, AS_OF, 14
    )


BY_SOURCE = f"""FROM app_events WHERE name = 'photo_captured'
    AND COALESCE(properties->>'$.source', 'app') = 'app' AND {SINCE_14_SQL}"""
BY_RANGE = f"""FROM app_events WHERE name = 'scan_started'
    AND properties->>'$.date_range' = '30days' AND {SINCE_14_SQL}"""
TOTALS = "SELECT count(*) AS total, count(DISTINCT device_id) AS unique_users"
query(
    "photos_by_source", lambda t: _photos_by_source(t).rows, E,
    f"SELECT device_id, event_ts, properties {BY_SOURCE} ORDER BY event_ts DESC, id DESC LIMIT 100 OFFSET 10",
)
query("photos_by_source_total", lambda t: _photos_by_source(t).total, E, f"{TOTALS} {BY_SOURCE}")
query(
    "scans_by_range", lambda t: _scans_by_range(t).rows, E,
    f"SELECT device_id, event_ts, properties {BY_RANGE} ORDER BY event_ts DESC, id DESC LIMIT 100",
)
query("scans_by_range_total", lambda t: _scans_by_range(t).total, E, f"{TOTALS} {BY_RANGE}")
query(
    "user_event_history", lambda t: feeds.user_event_history(t.app_events, "d8", 200), E,
    """SELECT id, name, category, properties, event_ts, session_id, session_duration_seconds, app_version
    FROM app_events WHERE device_id = 'd8' ORDER BY event_ts DESC, id DESC LIMIT 200""",
)

# Counts.

query(
    "table_summary", lambda t: ev.table_summary(t.app_events), E,
    """SELECT count(*) AS total_events, count(DISTINCT device_id) AS unique_devices,
    min(event_ts) AS first_event, max(event_ts) AS last_event FROM app_events""",
)
query(
    "recent_event_counts", lambda t: ev.recent_event_counts(t.app_events, AS_OF, hours=24), E,
    """SELECT name, count(*) AS count FROM app_events WHERE event_ts > TIMESTAMP '2024-01-29 23:59:59'
    GROUP BY name ORDER BY count DESC, name LIMIT 10""",
)
query(
    "event_counts", lambda t: ev.event_counts(t.app_events), E,
    "SELECT name, count(*) AS count FROM app_events GROUP BY name",
)
query(
    "top_event_counts", lambda t: ev.event_counts(t.app_events, MIDNIGHT_14, 10), E,
    f"""SELECT name, count(*) AS count FROM app_events WHERE {MIDNIGHT_14_SQL}
    GROUP BY name ORDER BY count DESC, name LIMIT 10""",
)
query(
    "event_type_catalog", lambda t: ev.event_type_catalog(t.app_events, AS_OF, 14), E,
    f"""SELECT name, category, count(*) AS count, count(DISTINCT device_id) AS unique_users,
    min(event_ts) AS first_occurrence, max(event_ts) AS last_occurrence
    FROM app_events WHERE {SINCE_14_SQL} GROUP BY name, category""",
)
query(
    "events_by_date", lambda t: ev.events_by_date(t.app_events, AS_OF, 30), E,
    """SELECT CAST(event_ts AS DATE) AS date, count(*) AS events, count(DISTINCT device_id) AS users
    FROM app_events WHERE event_ts >= TIMESTAMP '2023-12-31 23:59:59' GROUP BY 1""",
)
query(
    "events_by_date_of_one_type",
    lambda t: ev.events_by_date(t.app_events, AS_OF, 14, "gallery_viewed"), E,
    f"""SELECT CAST(event_ts AS DATE) AS date, count(*) AS events, count(DISTINCT device_id) AS users
    FROM app_events WHERE name = 'gallery_viewed' AND {SINCE_14_SQL} GROUP BY 1""",
)
query(
    "daily_active_users", lambda t: ev.daily_active_users(t.app_events, clock.since_midnight(AS_OF)), E,
    """SELECT CAST(event_ts AS DATE) AS date, count(DISTINCT device_id) AS users FROM app_events
    WHERE event_ts >= TIMESTAMP '2023-12-31 00:00:00' GROUP BY 1""",
)
query(
    "events_by_category", lambda t: ev.events_by_category(t.app_events, MIDNIGHT_14), E,
    f"SELECT category, count(*) AS count FROM app_events WHERE {MIDNIGHT_14_SQL} GROUP BY category",
)
query(
    "property_crosstab",
    lambda t: ev.property_crosstab(t.app_events, "photo_captured", ["source", "delete_schedule"]), E,
    """SELECT properties->>'$.source' AS source, properties->>'$.delete_schedule' AS delete_schedule,
    count(*) AS count FROM app_events WHERE name = 'photo_captured' GROUP BY 1, 2""",
)
query(
    "photo_sources",
    lambda t: ev.property_breakdown(t.app_events, "photo_captured", "source", "app", MIDNIGHT_14), E,
    f"""SELECT COALESCE(properties->>'$.source', 'app') AS source, count(*) AS count FROM app_events
    WHERE name = 'photo_captured' AND {MIDNIGHT_14_SQL} GROUP BY 1""",
)
query(
    "photo_schedules",
    lambda t: ev.property_breakdown(
        t.app_events, "photo_captured", "delete_schedule", "unknown", MIDNIGHT_14
    ), E,
    f"""SELECT COALESCE(properties->>'$.delete_schedule', 'unknown') AS delete_schedule,
    count(*) AS count FROM app_events
    WHERE name = 'photo_captured' AND {MIDNIGHT_14_SQL} GROUP BY 1""",
)
query(
    "schedule_distribution",
    lambda t: ev.property_breakdown(t.app_events, "photo_captured", "delete_schedule", bounds=RANGE), E,
    f"""SELECT properties->>'$.delete_schedule' AS delete_schedule, count(*) AS count FROM app_events
    WHERE name = 'photo_captured' AND {RANGE_SQL} GROUP BY 1""",
)
query(
    "spam_type_distribution",
    lambda t: ev.property_breakdown(t.app_events, "photo_captured", "spam_type", bounds=RANGE), E,
    f"""SELECT properties->>'$.spam_type' AS spam_type, count(*) AS count FROM app_events
    WHERE name = 'photo_captured' AND {RANGE_SQL} GROUP BY 1""",
)
query(
    "scan_date_ranges",
    lambda t: ev.property_breakdown(t.app_events, "scan_started", "date_range", "unknown", MIDNIGHT_14), E,
    f"""SELECT COALESCE(properties->>'$.date_range', 'unknown') AS date_range, count(*) AS count
    FROM app_events WHERE name = 'scan_started' AND {MIDNIGHT_14_SQL} GROUP BY 1""",
)
query(
    "photo_source_map",
    lambda t: ev.breakdown_map(
        ev.property_breakdown(t.app_events, "photo_captured", "source", "app", MIDNIGHT_14), "source"
    ).select(F.expr("counts['app']").alias("app"), F.expr("counts['widget']").alias("widget")), E,
    f"""SELECT count(*) FILTER (COALESCE(properties->>'$.source', 'app') = 'app') AS app,
    count(*) FILTER (properties->>'$.source' = 'widget') AS widget
    FROM app_events WHERE name = 'photo_captured' AND {MIDNIGHT_14_SQL}""",
)
query(
    "daily_counts", lambda t: ev.daily_counts(t.app_events, "photo_captured", RANGE), E,
    f"""SELECT CAST(event_ts AS DATE) AS date, count(*) AS count FROM app_events
    WHERE name = 'photo_captured' AND {RANGE_SQL} GROUP BY 1""",
)
query(
    "mean_events_per_user",
    lambda t: ev.mean_events_per_user(t.app_events, "photo_captured", MIDNIGHT_14), E,
    f"""SELECT {ratio('count(*)', 'count(DISTINCT device_id)')} AS events_per_user FROM app_events
    WHERE name = 'photo_captured' AND {MIDNIGHT_14_SQL}""",
)
query(
    "photo_summary", lambda t: ev.photo_summary(t.app_events, AS_OF, 14), E,
    f"""SELECT count(*) AS total_photos,
    {fixed(ratio('count(*)', 'count(DISTINCT device_id)'), 2)} AS photos_per_user,
    count(*) FILTER (COALESCE(properties->>'$.source', 'app') = 'app') AS from_app,
    count(*) FILTER (COALESCE(properties->>'$.source', 'app') = 'widget') AS from_widget
    FROM app_events WHERE name = 'photo_captured' AND {MIDNIGHT_14_SQL}""",
)
query(
    "feature_toggles", lambda t: ev.feature_toggles(t.app_events, RANGE), E,
    f"""SELECT properties->>'$.feature' AS feature,
    count(*) FILTER (CAST(properties->>'$.enabled' AS BOOLEAN)) AS enabled_count,
    count(*) FILTER (NOT CAST(properties->>'$.enabled' AS BOOLEAN)) AS disabled_count
    FROM app_events WHERE name = 'feature_toggled' AND {RANGE_SQL} GROUP BY 1""",
)
query(
    "deletion_mode_breakdown", lambda t: ev.deletion_mode_breakdown(t.app_events, RANGE), E,
    f"""SELECT properties->>'$.was_manual' AS was_manual, count(*) AS count FROM app_events
    WHERE name = 'photo_deleted' AND {RANGE_SQL} GROUP BY 1""",
)
SCAN_COLUMNS = ",\n".join(
    f"count(*) FILTER (name = 'scan_started' AND properties->>'$.date_range' = '{r}') AS scans_{r}"
    for r in ("7days", "30days", "6months", "all", "custom")
)
query(
    "feature_usage", lambda t: ev.feature_usage(t.app_events, RANGE), E,
    f"""SELECT count(*) FILTER (name = 'photo_captured') AS photos_captured,
    CAST(COALESCE(sum(CAST(properties->>'$.photos_scanned' AS INT)) FILTER (name = 'scan_completed'), 0) AS BIGINT) AS photos_scanned,
    count(*) FILTER (name = 'scan_started') AS scans_total, {SCAN_COLUMNS},
    count(*) FILTER (name = 'icloud_backup_toggled' AND CAST(properties->>'$.enabled' AS BOOLEAN)) AS icloud_backup_enabled,
    count(*) FILTER (name = 'widget_clicked') AS widget_clicks,
    count(*) FILTER (name = 'shortcut_tapped') AS shortcut_taps
    FROM app_events WHERE {RANGE_SQL}""",
)
query(
    "scan_summary", lambda t: ev.scan_summary(t.app_events, AS_OF, 14), E,
    f"""WITH s AS (
      SELECT count(*) FILTER (name = 'scan_started') AS started,
        count(*) FILTER (name = 'scan_completed') AS completed,
        COALESCE(avg(CAST(properties->>'$.duration_ms' AS DOUBLE)) FILTER (name = 'scan_completed'), 0) AS ms,
        CAST(COALESCE(sum(CAST(properties->>'$.photos_scanned' AS INT)) FILTER (name = 'scan_completed'), 0) AS BIGINT) AS photos,
        CAST(COALESCE(sum(CAST(properties->>'$.photos_classified' AS INT)) FILTER (name = 'scan_completed'), 0) AS BIGINT) AS spam,
        count(DISTINCT device_id) FILTER (name = 'scan_started') AS users
      FROM app_events WHERE {MIDNIGHT_14_SQL})
    SELECT started AS total_scans, completed AS completed_scans,
      {share('completed', 'started', 1)} AS completion_rate, {fixed('ms', 0)} AS avg_duration_ms,
      photos AS total_photos_scanned, {fixed(ratio('photos', 'completed'), 0)} AS photos_per_scan,
      spam AS spam_detected, {share('spam', 'photos', 1)} AS spam_rate,
      {fixed(ratio('started', 'users'), 1)} AS scans_per_user FROM s""",
)
query(
    "session_summary", lambda t: ev.session_summary(t.app_events, AS_OF, 14), E,
    f"""WITH s AS (
      SELECT count(DISTINCT session_id) AS sessions,
        count(DISTINCT device_id) FILTER (session_id IS NOT NULL) AS devices,
        count(*) FILTER (name = 'gallery_viewed') AS gallery
      FROM app_events WHERE {MIDNIGHT_14_SQL})
    SELECT sessions AS total_sessions, {fixed(ratio('sessions', 'devices'), 2)} AS sessions_per_user,
      gallery AS gallery_views, {ratio('gallery', 'sessions')} AS gallery_per_session FROM s""",
)
ACTIVE_USERS = f"""WITH s AS (
      SELECT count(DISTINCT device_id) FILTER (event_ts >= TIMESTAMP '2024-01-30') AS dau,
        count(DISTINCT device_id) FILTER (event_ts >= TIMESTAMP '2024-01-29' AND event_ts < TIMESTAMP '2024-01-30') AS dau_yesterday,
        count(DISTINCT device_id) FILTER (event_ts >= TIMESTAMP '2024-01-23') AS wau,
        count(DISTINCT device_id) FILTER (event_ts >= TIMESTAMP '2023-12-31') AS mau,
        count(DISTINCT device_id) AS total_users, count(*) AS total_events,
        count(*) FILTER (event_ts >= TIMESTAMP '2024-01-30') AS events_today,
        count(*) FILTER (event_ts >= TIMESTAMP '2023-12-31') AS events_month
      FROM app_events),
    n AS (SELECT count(*) AS new_users_today FROM (
      SELECT device_id FROM app_events GROUP BY device_id HAVING min(event_ts) >= TIMESTAMP '2024-01-30'))
    SELECT dau, dau_yesterday, {share('dau - dau_yesterday', 'dau_yesterday', 1)} AS dau_change, wau, mau,
      total_users, total_events, events_today, new_users_today,
      {fixed(ratio('events_month', 'mau'), 1)} AS avg_events_per_user FROM s, n"""
query("active_users", lambda t: ev.active_users(t.app_events, AS_OF), E, ACTIVE_USERS)


def _snapshot(t):
    """Two halves of the history, as two batches would leave them."""
    parts = [snapshot.device_snapshot(t.app_events.filter(f"id % 2 = {half}")) for half in (0, 1)]
    return snapshot.merged_snapshot(*parts)


query(
    "active_users_from_snapshot",
    lambda t: snapshot.active_users_from_snapshot(_snapshot(t), t.app_events, AS_OF), E, ACTIVE_USERS,
)
query(
    "device_snapshot", _snapshot, E,
    """SELECT device_id, min(event_ts) AS first_event, max(event_ts) AS last_event, count(*) AS events
    FROM app_events GROUP BY 1""",
)
query(
    "cohort_from_snapshot",
    lambda t: snapshot.cohort_from_snapshot(_snapshot(t), t.app_events, "2024-01-10", 7), E,
    """SELECT device_id, COALESCE(bool_or(CAST(event_ts AS DATE) = DATE '2024-01-17'), false) AS returned
    FROM app_events GROUP BY 1 HAVING CAST(min(event_ts) AS DATE) = DATE '2024-01-10'""",
)
query(
    "new_users_since",
    lambda t: ev.new_users_since(t.app_events, clock.midnight(AS_OF - timedelta(days=15))), E,
    """SELECT count(*) AS new_users FROM (SELECT device_id FROM app_events GROUP BY device_id
    HAVING min(event_ts) >= TIMESTAMP '2024-01-15')""",
)
query(
    "top_countries", lambda t: ev.country_users(t.app_events, k=10), E,
    """SELECT country, count(DISTINCT device_id) AS users FROM app_events WHERE country IS NOT NULL
    GROUP BY country ORDER BY users DESC, country LIMIT 10""",
)
query(
    "country_users", lambda t: ev.country_users(t.app_events, MIDNIGHT_14, 20), E,
    f"""SELECT country, count(DISTINCT device_id) AS users FROM app_events
    WHERE country IS NOT NULL AND {MIDNIGHT_14_SQL} GROUP BY country ORDER BY users DESC, country LIMIT 20""",
)
query(
    "country_events", lambda t: ev.country_events(t.app_events, MIDNIGHT_14, 20), E,
    f"""SELECT country, count(*) AS events FROM app_events
    WHERE country IS NOT NULL AND {MIDNIGHT_14_SQL} GROUP BY country ORDER BY events DESC, country LIMIT 20""",
)
query(
    "country_coverage", lambda t: ev.country_coverage(t.app_events, AS_OF, 14), E,
    f"""SELECT count(country) AS with_country, count(*) - count(country) AS without_country,
    count(*) AS total, {share('count(country)', 'count(*)', 1)} AS coverage_percent
    FROM app_events WHERE {MIDNIGHT_14_SQL}""",
)
DIMENSIONS = {
    "device_model": ("device_model", "device_model", 10),
    "timezone": ("timezone", "timezone", 15),
    "os_version": ("os_version", "os_version", 10),
    "locale_country": ("COALESCE(NULLIF(split_part(locale, '_', 2), ''), locale, 'Unknown')", "locale", 10),
    "locale_language": ("COALESCE(split_part(locale, '_', 1), 'unknown')", "locale", 10),
}
for dimension, (value, column, k) in DIMENSIONS.items():
    query(
        f"users_by_{dimension}",
        lambda t, d=dimension, k=k: ev.dimension_breakdown(t.app_events, d, RANGE, k), E,
        f"""SELECT {value} AS {dimension}, count(DISTINCT device_id) AS users FROM app_events
        WHERE {column} IS NOT NULL AND {RANGE_SQL} GROUP BY 1 ORDER BY users DESC, 1 LIMIT {k}""",
    )
query(
    "full_dimension_breakdown",
    lambda t: ev.dimension_breakdown(t.app_events, "timezone", RANGE), E,
    f"""SELECT timezone, count(DISTINCT device_id) AS users FROM app_events
    WHERE timezone IS NOT NULL AND {RANGE_SQL} GROUP BY 1""",
)
query(
    "engagement_buckets", lambda t: ev.engagement_buckets(t.app_events, RANGE), E,
    f"""WITH d AS (SELECT device_id, count(DISTINCT session_id) AS n FROM app_events
      WHERE session_id IS NOT NULL AND {RANGE_SQL} GROUP BY device_id),
    b(bucket_no, bucket, lo, hi) AS (VALUES (1, '1 session', 1, 1), (2, '2-5 sessions', 2, 5),
      (3, '6-10 sessions', 6, 10), (4, '10+ sessions', 11, 1000000000))
    SELECT bucket_no, bucket, count(n) AS user_count FROM b LEFT JOIN d ON n BETWEEN lo AND hi GROUP BY 1, 2""",
)
query(
    "session_duration_distribution", lambda t: ev.session_duration_distribution(t.app_events, RANGE), E,
    f"""WITH d AS (SELECT device_id, session_id, epoch_us(max(event_ts)) - epoch_us(min(event_ts)) AS us
      FROM app_events WHERE session_id IS NOT NULL AND {RANGE_SQL} GROUP BY 1, 2),
    m AS (SELECT floor(sum(us)::DOUBLE / count(*)::DOUBLE / 1000000.0::DOUBLE * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS mean_seconds FROM d),
    b(bucket_no, bucket, lo, hi) AS (VALUES (1, '< 30s', 0, 30), (2, '30s-1m', 30, 60), (3, '1-5m', 60, 300),
      (4, '5-15m', 300, 900), (5, '15m+', 900, 1000000000))
    SELECT bucket_no, bucket, count(us) AS count, max(mean_seconds) AS mean_seconds FROM b CROSS JOIN m
    LEFT JOIN d ON us >= lo::BIGINT * 1000000 AND us < hi::BIGINT * 1000000 GROUP BY 1, 2""",
)
query(
    "period_totals", lambda t: ev.period_totals(t.app_events, RANGE), E,
    f"""SELECT count(DISTINCT device_id) AS total_users, count(*) AS total_events
    FROM app_events WHERE {RANGE_SQL}""",
)
query(
    "uncastable_properties",
    lambda t: ev.uncastable_properties(
        t.app_events,
        {"photos_scanned": as_int(prop("photos_scanned")), "enabled": as_bool(prop("enabled")),
         "tier": as_int(prop("tier"))},
    ), E,
    """SELECT 'photos_scanned' AS property, count(*) FILTER (TRY_CAST(properties->>'$.photos_scanned' AS INT) IS NULL AND properties->>'$.photos_scanned' IS NOT NULL) AS bad_values FROM app_events
    UNION ALL SELECT 'enabled', count(*) FILTER (TRY_CAST(properties->>'$.enabled' AS BOOLEAN) IS NULL AND properties->>'$.enabled' IS NOT NULL) FROM app_events
    UNION ALL SELECT 'tier', count(*) FILTER (TRY_CAST(properties->>'$.tier' AS INT) IS NULL AND properties->>'$.tier' IS NOT NULL) FROM app_events""",
)

# The daily rollup; days at both ends have no events and still get a row.


def _rollup(t):
    dates = t.spark.sql(
        "SELECT explode(sequence(DATE '2023-12-25', DATE '2024-02-05')) AS date"
    )
    stats = rollup.rollup_daily_stats(t.app_events, dates)
    return stats.withColumn("revenue", F.col("revenue").cast("double"))


query(
    "daily_stats", _rollup, E,
    """WITH d AS (SELECT CAST(range AS DATE) AS date
      FROM range(DATE '2023-12-25', DATE '2024-02-06', INTERVAL 1 DAY))
    SELECT date, count(id) AS total_events, count(DISTINCT device_id) AS unique_devices,
      count(id) FILTER (name = 'photo_captured') AS photos_captured,
      count(id) FILTER (name = 'photo_deleted') AS photos_deleted,
      count(id) FILTER (name = 'paywall_viewed') AS paywall_views,
      count(id) FILTER (name = 'purchase_completed') AS purchases,
      CAST(COALESCE(sum(TRY_CAST(properties->>'$.revenue' AS DECIMAL(18,2))) FILTER (name = 'purchase_completed'), 0) AS DOUBLE) AS revenue
    FROM d LEFT JOIN app_events ON CAST(event_ts AS DATE) = date GROUP BY date""",
)
