"""Registered questions that are answered from what jobs keep beside the events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from catalog import users as _users  # noqa: F401, whose SQL is used again
from catalog.events import ACTIVE_USERS, E
from catalog.ingest import _event_stream, _finish
from catalog.registry import ORACLES, Tables, query
from catalog.views import AS_OF
from tallyroom import clock
from tallyroom.operators import device_days, feeds, snapshot, users
from tallyroom.session import scratch_path
from tallyroom.sources import files
from tallyroom.streaming import kept


def _bitmaps(t: Tables) -> DataFrame:
    """Two batches, each with devices of its own and some that both have."""
    path, stored = scratch_path(t.spark, "devices"), scratch_path(t.spark, "bitmaps")
    for half in (0, 1):
        batch = t.app_events.filter(f"id % 2 = {half}")
        part = device_days.day_bitmaps(batch, device_days.extend_devices(t.spark, path, batch))
        part.write.mode("append").parquet(stored)
    return device_days.merged_bitmaps(t.spark.read.parquet(stored))


query(
    "daily_active_users_from_bitmaps",
    lambda t: device_days.daily_active_users_from_bitmaps(_bitmaps(t), clock.since_midnight(AS_OF)), E,
)
ORACLES["daily_active_users_from_bitmaps"] = ORACLES["daily_active_users"]
DISTINCT = ["dau", "dau_yesterday", "dau_change", "wau", "mau", "total_users", "new_users_today"]
query(
    "active_users_from_bitmaps", lambda t: device_days.active_users_from_bitmaps(_bitmaps(t), AS_OF), E,
    f"WITH a AS ({ACTIVE_USERS}) SELECT {', '.join(DISTINCT)} FROM a",
)
query(
    "weekly_retention_from_bitmaps",
    lambda t: device_days.weekly_cohort_retention_from_bitmaps(_bitmaps(t), AS_OF), E,
)
ORACLES["weekly_retention_from_bitmaps"] = ORACLES["weekly_cohort_retention"]
query(
    "active_users_from_closed_history",
    lambda t: device_days.active_users_from_bitmaps(
        device_days.closed_history(_bitmaps(t), (AS_OF - timedelta(days=30)).date()), AS_OF
    ), E, f"WITH a AS ({ACTIVE_USERS}) SELECT {', '.join(DISTINCT)} FROM a",
)


def _kept_snapshot(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "kept-snapshot")
    _finish(kept.start_device_snapshot(_event_stream(t), f"{root}/devices", f"{root}/checkpoint", buckets=8))
    return kept.read_snapshot(t.spark, f"{root}/devices")


query(
    "stream_device_snapshot",
    lambda t: _kept_snapshot(t).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("first_event", "last_event")}
    ), E,
)
ORACLES["stream_device_snapshot"] = ORACLES["device_snapshot"]
query(
    "new_users_from_snapshot",
    lambda t: snapshot.new_users_from_snapshot(_kept_snapshot(t), clock.midnight(AS_OF - timedelta(days=15))), E,
)
ORACLES["new_users_from_snapshot"] = ORACLES["new_users_since"]
query(
    "weekly_cohort_retention_from_snapshot",
    lambda t: snapshot.weekly_cohort_retention_from_snapshot(_kept_snapshot(t), t.app_events, AS_OF), E,
)
ORACLES["weekly_cohort_retention_from_snapshot"] = ORACLES["weekly_cohort_retention"]


def _device_table(t: Tables) -> DataFrame:
    """The events in a table clustered by device, written in two appends."""
    path = scratch_path(t.spark, "by-device")
    for half in (0, 1):
        files.append_by_device(t.app_events.filter(f"id % 2 = {half}"), path, buckets=16)
    return t.spark.read.parquet(path)


query(
    "one_user_detail_from_device_table",
    lambda t: users.user_detail(_device_table(t), t.subscription_events, t.profiles, "d7", AS_OF), E,
)
ORACLES["one_user_detail_from_device_table"] = ORACLES["one_user_detail"]
query(
    "user_event_history_from_device_table", lambda t: feeds.user_event_history(_device_table(t), "d8", 200), E,
)
ORACLES["user_event_history_from_device_table"] = ORACLES["user_event_history"]
DEEP_SQL = """SELECT id, name, category, properties, event_ts, device_id, session_id, platform, os_version,
    device_model, app_version, locale FROM app_events ORDER BY event_ts DESC, id DESC LIMIT 75 OFFSET 400"""
query(
    "search_events_deep_offset",
    lambda t: feeds.search_events(t.app_events, limit=75, offset=400, deep=0).rows, E, DEEP_SQL,
)
