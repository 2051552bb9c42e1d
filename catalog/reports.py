"""Registered report summaries. The payloads are built by Spark from the given
tables in the shape the sources deliver, then read by the operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F, types as T

from catalog.events import E, MIDNIGHT_14, MIDNIGHT_14_SQL
from catalog.registry import Tables, query
from catalog.views import AS_OF
from tallyroom import clock, schema
from tallyroom.functions import hybrid_metric
from tallyroom.operators import events as ev, reports
from tallyroom.plans import join_single_rows
from tallyroom.session import scratch_path
from tallyroom.sources.files import read_report_json

# Series: daily active devices of each app version, one array entry per day.


def _landed(t: Tables, reports: DataFrame, payload: T.StructType, key: str) -> DataFrame:
    """Reports written as JSON documents and read again, with the column they are told
    apart by."""
    path = scratch_path(t.spark, "reports")
    reports.write.json(path)
    return read_report_json(t.spark, path, T.StructType([T.StructField(key, T.StringType()), *payload.fields]))


def _series(t: Tables) -> DataFrame:
    per_day = t.app_events.groupBy("app_version", F.to_date("event_ts").alias("d")).agg(
        F.countDistinct("device_id").cast("double").alias("v")
    )
    days = F.sort_array(F.collect_list(F.struct("d", "v")))
    reports = per_day.groupBy("app_version").agg(days.alias("days")).select(
        "app_version",
        F.transform("days", lambda x: x["d"].cast("string")).alias("xValues"),
        # The source leaves out the values of every seventh day of a month.
        F.array(F.transform("days", lambda x: F.when(F.dayofmonth(x["d"]) % 7 > 0, x["v"]))).alias("series"),
    )
    return _landed(t, reports, schema.SERIES_REPORT, "app_version")


SERIES = """WITH s AS (SELECT app_version, CAST(event_ts AS DATE) AS d,
    count(DISTINCT device_id)::DOUBLE AS n FROM app_events GROUP BY 1, 2),
  v AS (SELECT app_version, d, CASE WHEN day(d) % 7 > 0 THEN n ELSE 0 END AS count FROM s)"""
query(
    "report_series_rows", lambda t: reports.series_to_rows(_series(t), "app_version"), E,
    f"{SERIES} SELECT app_version, CAST(d AS VARCHAR) AS date, count FROM v",
)
query(
    "report_series_summary", lambda t: reports.series_summary(_series(t), "app_version"), E,
    f"""{SERIES} SELECT app_version, arg_max(count, d) AS latest, sum(count) AS total,
    COALESCE(floor(sum(count) FILTER (count > 0) / count(*) FILTER (count > 0) + 0.5), 0) AS average
    FROM v GROUP BY 1""",
)


def _session_report(t: Tables) -> DataFrame:
    per = t.app_events.groupBy("os_version").agg(
        (F.sum("session_duration_seconds") / F.count("session_duration_seconds")).alias("v")
    )
    reports = per.select(
        "os_version", F.array(F.array(F.struct(F.col("v").alias("value")))).alias("seriesCollapsed")
    )
    return _landed(t, reports, schema.SERIES_REPORT, "os_version")


query(
    "report_session_length",
    lambda t: reports.session_length_summary(_session_report(t), "os_version"), E,
    """WITH a AS (SELECT os_version, sum(session_duration_seconds)::DOUBLE / count(session_duration_seconds) AS average
      FROM app_events GROUP BY 1)
    SELECT os_version, average, CAST(floor(average / 60) AS BIGINT) || 'm '
      || CAST(floor(average - floor(average / 60) * 60 + 0.5) AS BIGINT) || 's' AS average_formatted FROM a""",
)

# Event totals: one report per app version.


def _totals(t: Tables) -> DataFrame:
    counts = t.app_events.groupBy("app_version", "name").agg(F.count(F.lit(1)).alias("totals"))
    reports = counts.groupBy("app_version").agg(
        F.sort_array(F.collect_list(F.struct("name", "totals"))).alias("data")
    )
    return _landed(t, reports, schema.EVENT_TOTALS_REPORT, "app_version")


TOTALS = "WITH c AS (SELECT app_version, name, count(*) AS n FROM app_events GROUP BY 1, 2)"
query(
    "report_event_totals",
    lambda t: reports.event_totals(_totals(t), ["photo_captured", "paywall_viewed", "screen_viewed"], "app_version"), E,
    f"""{TOTALS} SELECT app_version, CAST(sum(n) AS BIGINT) AS total_events,
    CAST(COALESCE(sum(n) FILTER (name = 'photo_captured'), 0) AS BIGINT) AS photo_captured,
    CAST(COALESCE(sum(n) FILTER (name = 'paywall_viewed'), 0) AS BIGINT) AS paywall_viewed,
    CAST(0 AS BIGINT) AS screen_viewed FROM c GROUP BY 1""",
)
query(
    "report_first_events", lambda t: reports.top_events(_totals(t), "app_version", k=10), E,
    f"""{TOTALS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY app_version ORDER BY name) AS INT) AS position FROM c)
    SELECT app_version, position, name, n AS count FROM r WHERE position <= 10""",
)
query(
    "report_top_events",
    lambda t: reports.top_events(_totals(t), "app_version", k=5, ranked=True), E,
    f"""{TOTALS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY app_version ORDER BY n DESC, name) AS INT) AS position FROM c)
    SELECT app_version, position, name, n AS count FROM r WHERE position <= 5""",
)


def _estimates(t: Tables) -> DataFrame:
    totals = reports.event_totals(_totals(t), ["app_opened", "photo_captured"], "app_version")
    active = reports.series_summary(_series(t), "app_version").select(
        "app_version", F.col("total").alias("active_users")
    )
    named = totals.select(
        "app_version", F.col("app_opened").alias("sessions"), F.col("photo_captured").alias("photos")
    )
    return reports.engagement_estimates(named.join(active, "app_version"), "app_version")


ESTIMATES = f"""{SERIES}, c AS (SELECT app_version, count(*) FILTER (name = 'app_opened') AS sessions,
    count(*) FILTER (name = 'photo_captured') AS photos FROM app_events GROUP BY 1),
  u AS (SELECT app_version, greatest(sum(count), 1) AS active_users FROM v GROUP BY 1),
  x AS (SELECT app_version, sessions, active_users,
    floor(sessions::DOUBLE / active_users * 10 + 0.5) / 10 AS sessions_per_user,
    floor(photos::DOUBLE / active_users * 10 + 0.5) / 10 AS photos_per_user,
    CAST(floor(photos::DOUBLE / sessions * 5 + 30 + 0.5) AS BIGINT) AS avg_session_duration_seconds
    FROM c JOIN u USING (app_version))"""
query("report_engagement_estimates", _estimates, E, f"{ESTIMATES} SELECT * FROM x")
query(
    "report_estimated_buckets",
    lambda t: reports.estimated_buckets(_estimates(t), "app_version"), E,
    f"""{ESTIMATES}, parts(kind, bucket, a, b) AS (VALUES ('engagement', '1 session', 0.4::DOUBLE, 0.4::DOUBLE),
      ('engagement', '2-5 sessions', 0.35::DOUBLE, 0.35::DOUBLE), ('engagement', '6-10 sessions', 0.15::DOUBLE, 0.15::DOUBLE),
      ('engagement', '10+ sessions', 0.1::DOUBLE, 0.1::DOUBLE), ('duration', '< 30s', 0.35::DOUBLE, 0.2::DOUBLE),
      ('duration', '30s-1m', 0.3::DOUBLE, 0.25::DOUBLE), ('duration', '1-5m', 0.3::DOUBLE, 0.3::DOUBLE),
      ('duration', '5-15m', 0.12::DOUBLE, 0.12::DOUBLE), ('duration', '15m+', 0.03::DOUBLE, 0.03::DOUBLE))
    SELECT app_version, kind, bucket, CAST(floor(CASE WHEN kind = 'engagement' THEN active_users ELSE sessions::DOUBLE END
      * CASE WHEN avg_session_duration_seconds < CASE WHEN bucket = '30s-1m' THEN 120 ELSE 60 END THEN a ELSE b END
      + 0.5) AS BIGINT) AS count FROM x CROSS JOIN parts WHERE sessions > 0""",
)


def _curves(t: Tables) -> DataFrame:
    """Share of a version's devices active n days after their first day, n = 0..20."""
    days = t.app_events.groupBy("app_version", "device_id", F.to_date("event_ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n")
    )
    firsts = days.groupBy("app_version", "device_id").agg(F.min("d").alias("first"))
    gaps = days.join(firsts, ["app_version", "device_id"]).withColumn("gap", F.datediff("d", "first"))
    kept = [F.count_if(F.col("gap") == n) / F.count_if(F.col("gap") == 0) for n in range(21)]
    return gaps.groupBy("app_version").agg(F.array(*kept).alias("combinedRetention"))


query(
    "report_retention_curve", lambda t: reports.retention_curve_points(_curves(t), "app_version"), E,
    """WITH d AS (SELECT DISTINCT app_version, device_id, CAST(event_ts AS DATE) AS d FROM app_events),
    g AS (SELECT app_version, d - min(d) OVER (PARTITION BY app_version, device_id) AS gap FROM d)
    SELECT app_version,
      CAST(floor(count(*) FILTER (gap = 1)::DOUBLE / count(*) FILTER (gap = 0) * 100 + 0.5) AS BIGINT) AS d1,
      CAST(floor(count(*) FILTER (gap = 7)::DOUBLE / count(*) FILTER (gap = 0) * 100 + 0.5) AS BIGINT) AS d7,
      CAST(0 AS BIGINT) AS d30 FROM g GROUP BY 1""",
)


def _hybrid(t: Tables) -> DataFrame:
    """The report says nothing about users, so the stored events answer."""
    reported = reports.event_totals(_totals(t), [], "app_version").agg(
        F.sum("total_events").alias("reported_events"), F.lit(0).cast("bigint").alias("reported_users")
    )
    one = join_single_rows(reported, ev.period_totals(t.app_events, MIDNIGHT_14))
    return one.select(
        hybrid_metric(F.col("reported_users"), F.col("total_users")).alias("total_users"),
        hybrid_metric(F.col("reported_events"), F.col("total_events")).alias("total_events"),
    )


query(
    "hybrid_overview", _hybrid, E,
    f"""SELECT count(DISTINCT device_id) FILTER ({MIDNIGHT_14_SQL}) AS total_users,
    count(*) AS total_events FROM app_events""",
)

# Issues, built from the error events.


def _issues(t: Tables) -> DataFrame:
    return t.issue_events.groupBy("issue_id", "level").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("event_ts").alias("firstSeen"),
        F.max("event_ts").alias("lastSeen"),
        F.concat(F.lit("APP-"), F.col("issue_id").cast("string")).alias("shortId"),
    )


def _issue_stats(t: Tables) -> DataFrame:
    """Day pairs ``[epoch seconds, count]`` in one payload per level."""
    per_day = t.issue_events.groupBy(
        "level", F.unix_seconds(F.to_date("event_ts").cast("timestamp")).alias("epoch")
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy("level").agg(F.collect_list(F.array("epoch", "n")).alias("stats"))


I = "issue_events"
query(
    "issue_summary",
    lambda t: reports.issue_summary(_issues(t), reports.issue_stat_rows(_issue_stats(t))), I,
    """SELECT count(*) AS total_events, count(DISTINCT issue_id) AS unresolved_issues,
    count(DISTINCT issue_id) FILTER (level IN ('fatal', 'error')) AS critical_issues FROM issue_events""",
)
ISSUES = """SELECT issue_id, level, count(*) AS count, min(event_ts) AS first_seen,
    max(event_ts) AS last_seen, 'APP-' || CAST(issue_id AS VARCHAR) AS short_id FROM issue_events GROUP BY 1, 2"""
query("issue_list", lambda t: reports.issue_list(_issues(t)), I, ISSUES)
query(
    "issue_events_by_day",
    lambda t: reports.issue_events_by_day(reports.issue_stat_rows(_issue_stats(t)))
    .groupBy("date").agg(F.sum("count").alias("count")), I,
    "SELECT CAST(event_ts AS DATE) AS date, count(*) AS count FROM issue_events GROUP BY 1",
)
query(
    "issue_recent_events",
    lambda t: reports.issue_recent_events(
        reports.issue_list(_issues(t)), t.issue_events.drop("level"), 10
    ), I,
    f"""WITH i AS ({ISSUES}), r AS (SELECT id, issue_id, event_ts, value,
      CAST(row_number() OVER (PARTITION BY issue_id ORDER BY event_ts DESC, id DESC) AS INT) AS event_rank FROM issue_events)
    SELECT * FROM i JOIN r USING (issue_id) WHERE event_rank <= 10""",
)

# Reviews, versions and search rows.

query(
    "review_rows",
    lambda t: reports.review_rows(t.reviews.withColumnRenamed("created_date", "createdDate"), 40), "reviews",
    """SELECT id, rating, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS body,
    CAST(NULL AS VARCHAR) AS "reviewerNickname", created_date AS "createdDate", territory
    FROM reviews ORDER BY created_date DESC, id DESC LIMIT 40""",
)
query(
    "review_summary", lambda t: reports.review_summary(t.reviews), "reviews",
    """SELECT count(*) AS total_reviews,
    floor(sum(COALESCE(rating, 0))::DOUBLE / count(*) * 10 + 0.5) / 10 AS average_rating,
    count(*) FILTER (rating = 1) AS rating_1, count(*) FILTER (rating = 2) AS rating_2,
    count(*) FILTER (rating = 3) AS rating_3, count(*) FILTER (rating = 4) AS rating_4,
    count(*) FILTER (rating = 5) AS rating_5 FROM reviews""",
)


def _versions(t: Tables) -> DataFrame:
    seen = t.app_events.groupBy("app_version", "os_version").agg(F.min("event_ts").alias("createdDate"))
    return seen.select(
        F.concat_ws("/", "app_version", "os_version").alias("id"),
        F.col("app_version").alias("versionString"),
        F.lit("READY").alias("appStoreState"),
        F.lit("MANUAL").alias("releaseType"),
        "createdDate",
    )


query(
    "version_history", lambda t: reports.version_history(_versions(t), 10), E,
    """SELECT app_version || '/' || os_version AS id, app_version AS versionString,
    'READY' AS appStoreState, 'MANUAL' AS releaseType, min(event_ts) AS createdDate
    FROM app_events GROUP BY app_version, os_version ORDER BY createdDate DESC, id DESC LIMIT 10""",
)


def _round(value: str, digits: int) -> str:
    scale = 10**digits
    return f"floor(({value}) * {scale}.0::DOUBLE + 0.5) / {scale}.0::DOUBLE"


R = "search_rows"
LAGGED = clock.lagged_window(AS_OF - timedelta(days=3), 20)
LAGGED_SQL = "date >= DATE '2024-01-05' AND date <= DATE '2024-01-25'"
query(
    "search_totals", lambda t: reports.search_totals(LAGGED.apply(t.search_rows, "date")), R,
    f"""SELECT CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
    {_round('sum(clicks)::DOUBLE / sum(impressions)::DOUBLE * 100', 2)} AS ctr,
    {_round('sum(position) / count(*)', 1)} AS avg_position FROM search_rows WHERE {LAGGED_SQL}""",
)
for dim, limit in (("query", 100), ("page", 50), ("device", None)):
    query(
        f"search_by_{dim}",
        lambda t, d=dim, k=limit: reports.search_by_dimension(
            t.search_rows.filter(F.col("dim") == d), d, k, LAGGED
        ), R,
        f"""SELECT key AS {dim}, clicks, impressions, floor(ctr * 10000 + 0.5) / 100 AS ctr,
        {_round('position', 1)} AS position FROM search_rows WHERE dim = '{dim}' AND {LAGGED_SQL}
        ORDER BY clicks DESC, impressions DESC, key {f'LIMIT {limit}' if limit else ''}""",
    )
query(
    "search_daily",
    lambda t: reports.search_by_dimension(
        t.search_rows.groupBy(F.col("date").cast("string").alias("key")).agg(
            F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
            (F.sum("clicks") / F.sum("impressions")).alias("ctr"), F.avg("position").alias("position"),
        ), "date",
    ), R,
    f"""SELECT CAST(date AS VARCHAR) AS date, CAST(sum(clicks) AS BIGINT) AS clicks,
    CAST(sum(impressions) AS BIGINT) AS impressions,
    floor(sum(clicks)::DOUBLE / sum(impressions)::DOUBLE * 10000 + 0.5) / 100 AS ctr,
    {_round('avg(position)', 1)} AS position FROM search_rows GROUP BY 1""",
)
