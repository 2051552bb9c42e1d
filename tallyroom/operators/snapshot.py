"""What is known of every device's whole history, kept beside the events.

A snapshot has one row per device: first and last event, number of events. Jobs add what
each batch brings; questions about first activity or totals then read the snapshot, and
of the events only their window.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyroom import clock
from tallyroom.clock import Bounds
from tallyroom.functions.counts import n_rows
from tallyroom.operators.events import active_columns, active_flags
from tallyroom.operators.retention import WEEKLY_PERIODS, cohort_rows, weeks_and_days
from tallyroom.plans import device_flags


def device_snapshot(events: DataFrame) -> DataFrame:
    """device_id, first_event, last_event, events. Of a batch, what it adds."""
    return events.groupBy("device_id").agg(
        F.min("event_ts").alias("first_event"), F.max("event_ts").alias("last_event"), n_rows().alias("events")
    )


def merged_snapshot(*parts: DataFrame) -> DataFrame:
    """One snapshot of disjoint parts of the history, each once."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("device_id").agg(
        F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"),
        F.sum("events").alias("events"),
    )


def active_users_from_snapshot(
    snapshot: DataFrame, events: DataFrame, as_of: datetime | None = None
) -> DataFrame:
    """``events.active_users`` with the totals and newcomers of a snapshot that covers all
    ``events``; of these, the last thirty days alone are read."""
    today = clock.midnight(clock.resolve(as_of))
    window = Bounds(lo=today - timedelta(days=30)).apply(events, "event_ts")
    flags, measures = active_flags(events, today)
    recent = device_flags(window, {k: v for k, v in flags.items() if k != "_before_today"}, *measures)
    new = Bounds(lo=today).holds(snapshot, "first_event")
    both = snapshot.select("device_id", F.col("events").alias("_n"), (~new).alias("_before_today")).join(
        recent.drop("_n"), "device_id", "left"
    )
    return active_columns(both)


def new_users_from_snapshot(snapshot: DataFrame, moment: datetime) -> DataFrame:
    """Devices whose first event ever is at or after ``moment``."""
    return Bounds(lo=moment).apply(snapshot, "first_event").agg(n_rows().alias("new_users"))


def cohort_from_snapshot(snapshot: DataFrame, events: DataFrame, day, return_day: int) -> DataFrame:
    """Devices first seen on ``day`` and whether each was active that many days later; only
    that later day's events are read."""
    start = clock.as_date(day)
    members = clock.one_day(start).apply(snapshot, "first_event").select("device_id")
    back = clock.one_day(start + timedelta(days=int(return_day))).apply(events, "event_ts")
    seen = back.select("device_id").distinct().withColumn("returned", F.lit(True))
    return members.join(seen, "device_id", "left").withColumn("returned", F.coalesce("returned", F.lit(False)))


def weekly_cohort_retention_from_snapshot(
    snapshot: DataFrame, events: DataFrame, as_of: datetime | None = None, weeks: int = 4,
    periods: tuple[int, ...] = WEEKLY_PERIODS,
) -> DataFrame:
    """``retention.weekly_cohort_retention`` with the first events of a snapshot that covers
    all ``events``; of these, only the days that cohorts are asked for are read."""
    ends, over = weeks_and_days(as_of, weeks, periods)
    asked = reduce(lambda a, b: a | b, [clock.one_day(d).holds(events, "event_ts") for d in over], F.lit(False))
    if over:
        events = Bounds(over[0], over[-1] + timedelta(days=1), hi_open=True).apply(events, "event_ts")
    flags = {f"_on_{d:%Y%m%d}": clock.one_day(d).holds(events, "event_ts") for d in over}
    seen = device_flags(events.where(asked), flags, n_rows().alias("_n")).drop("_n")
    first, last = min(ends) - timedelta(days=7), max(ends)
    joined = Bounds(first, last, hi_open=True).apply(snapshot, "first_event")
    devices = joined.select("device_id", F.col("first_event").alias("first_seen")).join(seen, "device_id", "left")
    return cohort_rows(devices, ends, over, periods)
