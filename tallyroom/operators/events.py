"""Event aggregations: counts, breakdowns, activity and engagement."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tallyroom import clock
from tallyroom.clock import ALL_TIME, Bounds
from tallyroom.functions import (
    as_bool, as_double, as_int, js_round, locale_country, locale_language, percent, prop, ratio,
    to_fixed,
)
from tallyroom.functions.counts import n_distinct, n_rows
from tallyroom.plans import device_flags, single_row_to_rows, top_k


# The scan ranges with a column of their own.
SCAN_RANGES = ["7days", "30days", "6months", "all", "custom"]



def _day() -> Column:
    return F.to_date("event_ts").alias("date")


def _named(events: DataFrame, name: str | None) -> DataFrame:
    return events if name is None else events.filter(F.col("name") == name)


def table_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        n_rows().alias("total_events"),
        n_distinct("device_id").alias("unique_devices"),
        F.min("event_ts").alias("first_event"),
        F.max("event_ts").alias("last_event"),
    )


def event_counts(events: DataFrame, bounds: Bounds = ALL_TIME, k: int | None = None) -> DataFrame:
    """Events by name, most frequent first."""
    counts = bounds.apply(events, "event_ts").groupBy("name").agg(n_rows().alias("count"))
    return top_k(counts, F.desc("count"), F.asc("name"), k=k)


def recent_event_counts(
    events: DataFrame, as_of: datetime | None = None, hours: int = 1, k: int = 10
) -> DataFrame:
    """Most frequent events strictly after ``hours`` before ``as_of``."""
    lo = clock.resolve(as_of) - timedelta(hours=hours)
    return event_counts(events, Bounds(lo=lo, lo_open=True), k)


def event_type_catalog(
    events: DataFrame, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    return (
        clock.since(as_of, days).apply(events, "event_ts")
        .groupBy("name", "category")
        .agg(
            n_rows().alias("count"),
            n_distinct("device_id").alias("unique_users"),
            F.min("event_ts").alias("first_occurrence"),
            F.max("event_ts").alias("last_occurrence"),
        )
        .orderBy(F.desc("count"), "name", "category")
    )


def events_by_date(
    events: DataFrame, as_of: datetime | None = None, days: int = 30, name: str | None = None
) -> DataFrame:
    """Events and devices per day, newest day first."""
    return (
        _named(clock.since(as_of, days).apply(events, "event_ts"), name)
        .groupBy(_day())
        .agg(n_rows().alias("events"), n_distinct("device_id").alias("users"))
        .orderBy(F.desc("date"))
    )


def daily_active_users(events: DataFrame, bounds: Bounds) -> DataFrame:
    return (
        bounds.apply(events, "event_ts").groupBy(_day()).agg(n_distinct("device_id").alias("users"))
        .orderBy("date")
    )


def events_by_category(events: DataFrame, bounds: Bounds) -> DataFrame:
    counts = bounds.apply(events, "event_ts").groupBy("category").agg(n_rows().alias("count"))
    return counts.orderBy(F.desc("count"), "category")


def property_crosstab(events: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Events of one type by several properties; a missing value is a group."""
    return _named(events, name).groupBy(*[prop(k).alias(k) for k in keys]).agg(n_rows().alias("count"))


def property_breakdown(
    events: DataFrame,
    name: str,
    key: str,
    default: str | None = None,
    bounds: Bounds = ALL_TIME,
) -> DataFrame:
    """Events of one type by one property, most frequent first. Missing values are
    labelled ``default``, or form a null group."""
    value = prop(key) if default is None else F.coalesce(prop(key), F.lit(default))
    found = _named(bounds.apply(events, "event_ts"), name)
    return found.groupBy(value.alias(key)).agg(n_rows().alias("count")).orderBy(F.desc("count"), key)


def breakdown_map(breakdown: DataFrame, key: str) -> DataFrame:
    """A breakdown as one ``{value: count}`` map, without its null group. The map is a
    single row; a property of very many values is better left as a breakdown."""
    entries = breakdown.filter(F.col(key).isNotNull())
    return entries.agg(F.map_from_entries(F.collect_list(F.struct(key, "count"))).alias("counts"))


def deletion_mode_breakdown(events: DataFrame, bounds: Bounds) -> DataFrame:
    return property_breakdown(events, "photo_deleted", "was_manual", bounds=bounds)


def daily_counts(events: DataFrame, name: str, bounds: Bounds) -> DataFrame:
    """Events of one type per day, oldest first."""
    found = _named(bounds.apply(events, "event_ts"), name)
    return found.groupBy(_day()).agg(n_rows().alias("count")).orderBy("date")


def mean_events_per_user(
    events: DataFrame, name: str | None = None, bounds: Bounds = ALL_TIME
) -> DataFrame:
    found = _named(bounds.apply(events, "event_ts"), name)
    return found.agg(ratio(n_rows(), n_distinct("device_id")).alias("events_per_user"))


def photo_summary(events: DataFrame, as_of: datetime | None = None, days: int = 30) -> DataFrame:
    """Photos taken, per user, and by origin, in one pass."""
    source = F.coalesce(prop("source"), F.lit("app"))
    photos = _named(clock.since_midnight(as_of, days).apply(events, "event_ts"), "photo_captured")
    return photos.agg(
        n_rows().alias("total_photos"),
        to_fixed(ratio(n_rows(), n_distinct("device_id")), 2).alias("photos_per_user"),
        F.count_if(source == "app").alias("from_app"),
        F.count_if(source == "widget").alias("from_widget"),
    )


def feature_toggles(events: DataFrame, bounds: Bounds) -> DataFrame:
    """Switch-on and switch-off counts by feature; an unreadable flag is neither."""
    enabled = as_bool(prop("enabled"))
    found = _named(bounds.apply(events, "event_ts"), "feature_toggled")
    return found.groupBy(prop("feature").alias("feature")).agg(
        F.count_if(enabled).alias("enabled_count"), F.count_if(~enabled).alias("disabled_count")
    )


def feature_usage(events: DataFrame, bounds: Bounds) -> DataFrame:
    """One row of usage counters from a single scan of the six event types."""
    name = F.col("name")
    scanned = F.when(name == "scan_completed", as_int(prop("photos_scanned")))
    scan_range = F.when(name == "scan_started", prop("date_range"))
    used = ["photo_captured", "scan_started", "scan_completed", "widget_clicked",
            "shortcut_tapped", "icloud_backup_toggled"]
    return (
        bounds.apply(events, "event_ts").filter(name.isin(used))
        .agg(
            F.count_if(name == "photo_captured").alias("photos_captured"),
            F.coalesce(F.sum(scanned), F.lit(0)).alias("photos_scanned"),
            F.count_if(name == "scan_started").alias("scans_total"),
            *[F.count_if(scan_range == r).alias(f"scans_{r}") for r in SCAN_RANGES],
            F.count_if(
                F.when(name == "icloud_backup_toggled", as_bool(prop("enabled")))
            ).alias("icloud_backup_enabled"),
            F.count_if(name == "widget_clicked").alias("widget_clicks"),
            F.count_if(name == "shortcut_tapped").alias("shortcut_taps"),
        )
    )


def scan_summary(events: DataFrame, as_of: datetime | None = None, days: int = 30) -> DataFrame:
    """Scan counts, completion, duration and yield in one row; every rate is 0 when
    there is nothing to divide by."""
    name = F.col("name")
    done = name == "scan_completed"
    started, completed, users = F.col("total_scans"), F.col("completed_scans"), F.col("_users")
    photos, spam = F.col("total_photos_scanned"), F.col("spam_detected")
    sums = (
        clock.since_midnight(as_of, days).apply(events, "event_ts")
        .filter(name.isin("scan_started", "scan_completed"))
        .agg(
            F.count_if(name == "scan_started").alias("total_scans"),
            F.count_if(done).alias("completed_scans"),
            F.coalesce(F.avg(F.when(done, as_double(prop("duration_ms")))), F.lit(0.0))
            .alias("_avg_ms"),
            F.coalesce(F.sum(F.when(done, as_int(prop("photos_scanned")))), F.lit(0))
            .alias("total_photos_scanned"),
            F.coalesce(F.sum(F.when(done, as_int(prop("photos_classified")))), F.lit(0))
            .alias("spam_detected"),
            F.countDistinct(F.when(name == "scan_started", F.col("device_id"))).alias("_users"),
        )
    )
    return sums.select(
        "total_scans",
        "completed_scans",
        percent(completed, started, 1).alias("completion_rate"),
        to_fixed(F.col("_avg_ms"), 0).alias("avg_duration_ms"),
        "total_photos_scanned",
        to_fixed(ratio(photos, completed), 0).alias("photos_per_scan"),
        "spam_detected",
        percent(spam, photos, 1).alias("spam_rate"),
        to_fixed(ratio(started, users), 1).alias("scans_per_user"),
    )


def session_summary(events: DataFrame, as_of: datetime | None = None, days: int = 30) -> DataFrame:
    """Sessions, sessions per user and gallery views per session.

    Events shrink to (session, device) rows before the two distinct counts.
    """
    pairs = (
        clock.since_midnight(as_of, days).apply(events, "event_ts")
        .groupBy("session_id", "device_id")
        .agg(F.count_if(F.col("name") == "gallery_viewed").alias("_gallery"))
    )
    in_session = F.when(F.col("session_id").isNotNull(), F.col("device_id"))
    sums = pairs.agg(
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct(in_session).alias("_devices"),
        F.coalesce(F.sum("_gallery"), F.lit(0)).alias("gallery_views"),
    )
    sessions = F.col("total_sessions")
    return sums.select(
        "total_sessions",
        to_fixed(ratio(sessions, F.col("_devices")), 2).alias("sessions_per_user"),
        "gallery_views",
        ratio(F.col("gallery_views"), sessions).alias("gallery_per_session"),
    )


def active_flags(events: DataFrame, today: datetime) -> tuple[dict[str, Column], list[Column]]:
    """Flags and measures of a device for ``active_columns``; all lower bounds are
    midnights and open-ended."""
    since = {d: Bounds(lo=today - timedelta(days=d)).holds(events, "event_ts") for d in (0, 1, 7, 30)}
    flags = {
        "_today": since[0],
        "_yesterday": since[1] & ~since[0],
        "_week": since[7],
        "_month": since[30],
        "_before_today": ~since[0],
    }
    measures = [
        n_rows().alias("_n"),
        F.count_if(since[0]).alias("_n_today"),
        F.count_if(since[30]).alias("_n_month"),
    ]
    return flags, measures


def active_columns(per_device: DataFrame) -> DataFrame:
    """Devices with their flags and measures to one row of figures."""
    sums = per_device.agg(
        F.count_if("_today").alias("dau"),
        F.count_if("_yesterday").alias("dau_yesterday"),
        F.count_if("_week").alias("wau"),
        F.count_if("_month").alias("mau"),
        n_rows().alias("total_users"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("_n_today"), F.lit(0)).alias("events_today"),
        F.count_if(F.col("_today") & ~F.col("_before_today")).alias("new_users_today"),
        F.coalesce(F.sum("_n_month"), F.lit(0)).alias("_n_month"),
    )
    dau, before = F.col("dau"), F.col("dau_yesterday")
    return sums.select(
        "dau", "dau_yesterday",
        percent(dau - before, before, 1).alias("dau_change"),
        "wau", "mau", "total_users", "total_events", "events_today", "new_users_today",
        to_fixed(ratio(F.col("_n_month"), F.col("mau")), 1).alias("avg_events_per_user"),
    )


def active_users(events: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Daily, weekly and monthly active devices, totals and newcomers, in one row.

    One shuffle of per-device flags. It reads the whole history, for the totals and the
    newcomers; ``snapshot.active_users_from_snapshot`` reads its last month alone.
    """
    flags, measures = active_flags(events, clock.midnight(clock.resolve(as_of)))
    return active_columns(device_flags(events, flags, *measures))


def new_users_since(events: DataFrame, moment: datetime) -> DataFrame:
    """Devices whose first event ever is at or after ``moment``."""
    firsts = events.groupBy("device_id").agg(F.min("event_ts").alias("first_seen"))
    late = Bounds(lo=moment).apply(firsts, "first_seen")
    return late.agg(n_rows().alias("new_users"))


def country_users(events: DataFrame, bounds: Bounds = ALL_TIME, k: int = 20) -> DataFrame:
    return dimension_breakdown(events, "country", bounds, k)


def country_events(events: DataFrame, bounds: Bounds = ALL_TIME, k: int = 20) -> DataFrame:
    found = bounds.apply(events, "event_ts").filter(F.col("country").isNotNull())
    counts = found.groupBy("country").agg(n_rows().alias("events"))
    return top_k(counts, F.desc("events"), F.asc("country"), k=k)


def country_coverage(events: DataFrame, as_of: datetime | None = None, days: int = 30) -> DataFrame:
    known = F.col("country").isNotNull()
    sums = clock.since_midnight(as_of, days).apply(events, "event_ts").agg(
        F.count_if(known).alias("with_country"),
        F.count_if(~known).alias("without_country"),
        n_rows().alias("total"),
    )
    return sums.withColumn("coverage_percent", percent(F.col("with_country"), F.col("total"), 1))


def dimension_breakdown(
    events: DataFrame, dimension: str, bounds: Bounds = ALL_TIME, k: int | None = None
) -> DataFrame:
    """The ``k`` top values, or all, of a column, or of the country or language part of the
    locale, by devices. The derived value is grouped under its own name, never ``country``."""
    derived = {
        "locale_country": ("locale", locale_country(F.col("locale"))),
        "locale_language": ("locale", locale_language(F.col("locale"))),
    }
    column, value = derived.get(dimension, (dimension, F.col(dimension)))
    found = bounds.apply(events, "event_ts").filter(F.col(column).isNotNull())
    counts = found.groupBy(value.alias(dimension)).agg(n_distinct("device_id").alias("users"))
    return top_k(counts, F.desc("users"), F.asc(dimension), k=k)


def engagement_buckets(events: DataFrame, bounds: Bounds) -> DataFrame:
    """Devices by their number of sessions; ``10+`` starts at eleven."""
    per_device = (
        bounds.apply(events, "event_ts").filter(F.col("session_id").isNotNull())
        .groupBy("device_id").agg(F.countDistinct("session_id").alias("_n"))
    )
    n = F.col("_n")
    sums = per_device.agg(
        F.count_if(n == 1).alias("b1"),
        F.count_if(n.between(2, 5)).alias("b2"),
        F.count_if(n.between(6, 10)).alias("b3"),
        F.count_if(n > 10).alias("b4"),
    )
    labels = ["1 session", "2-5 sessions", "6-10 sessions", "10+ sessions"]
    return single_row_to_rows(
        sums,
        [{"bucket_no": F.lit(i), "bucket": F.lit(label), "user_count": F.col(f"b{i}")}
         for i, label in enumerate(labels, 1)],
    )


def session_duration_distribution(events: DataFrame, bounds: Bounds) -> DataFrame:
    """Sessions by length, with the mean length of all sessions on every row."""
    sessions = (
        bounds.apply(events, "event_ts").filter(F.col("session_id").isNotNull())
        .groupBy("device_id", "session_id")
        .agg(F.timestamp_diff("MICROSECOND", F.min("event_ts"), F.max("event_ts")).alias("_us"))
    )
    second = 1_000_000
    us = F.col("_us")
    edges = [0, 30 * second, 60 * second, 300 * second, 900 * second]
    tests = [(us >= lo) & (us < hi) for lo, hi in zip(edges, edges[1:])] + [us >= edges[-1]]
    labels = ["< 30s", "30s-1m", "1-5m", "5-15m", "15m+"]
    sums = sessions.agg(
        *[F.count_if(test).alias(f"b{i}") for i, test in enumerate(tests, 1)],
        F.sum(us.cast("decimal(20,0)")).alias("_total_us"),
        n_rows().alias("_n"),
    )
    mean = ratio(F.col("_total_us"), F.col("_n")) / float(second)
    return single_row_to_rows(
        sums,
        [{"bucket_no": F.lit(i), "bucket": F.lit(label), "count": F.col(f"b{i}"),
          "mean_seconds": js_round(mean, 3)}
         for i, label in enumerate(labels, 1)],
    )


def period_totals(events: DataFrame, bounds: Bounds) -> DataFrame:
    return bounds.apply(events, "event_ts").agg(
        n_distinct("device_id").alias("total_users"), n_rows().alias("total_events")
    )


def uncastable_properties(
    events: DataFrame, checks: dict[str, Column], bounds: Bounds = ALL_TIME
) -> DataFrame:
    """Rows whose property is present but yields null under the given cast, per
    property: the values the other operators leave out."""
    sums = bounds.apply(events, "event_ts").agg(
        *[F.count_if(prop(key).isNotNull() & cast.isNull()).alias(f"bad_{key}")
          for key, cast in checks.items()]
    )
    return single_row_to_rows(
        sums, [{"property": F.lit(key), "bad_values": F.col(f"bad_{key}")} for key in checks]
    )
