"""Per-device summary with distinct sessions and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ATTRIBUTES = [
    "user_id", "platform", "os_version", "device_model", "app_version", "locale", "timezone",
]


def device_totals(
    events: DataFrame,
    attributes: list[str],
    sums: dict[str, Column] | None = None,
    max_duration: bool = False,
) -> DataFrame:
    """One row per device: first and last event, number of events, the greatest value
    of each attribute; ``sums`` adds measures that are summed over the device's events.

    Events are hash-aggregated to (device, attributes), a few rows per device, before
    the text maxima, which Spark can only sort-aggregate.
    """
    sums = sums or {}
    fine = [
        F.count(F.lit(1)).alias("total_events"),
        F.min("event_ts").alias("first_seen"),
        F.max("event_ts").alias("last_active"),
        *[F.sum(value).alias(name) for name, value in sums.items()],
    ]
    if max_duration:
        fine.append(F.max("session_duration_seconds").alias("max_session_duration"))
    combined = events.groupBy("device_id", *attributes).agg(*fine)
    if not attributes:
        return combined
    coarse = [
        F.sum("total_events").alias("total_events"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_active").alias("last_active"),
        *[F.max(c).alias(c) for c in attributes],
        *[F.sum(name).alias(name) for name in sums],
    ]
    if max_duration:
        coarse.append(F.max("max_session_duration").alias("max_session_duration"))
    return combined.groupBy("device_id").agg(*coarse)


def device_rollup(
    events: DataFrame, sums: dict[str, Column] | None = None, max_duration: bool = False
) -> DataFrame:
    """``device_totals`` over all attributes plus the device's distinct sessions and days.

    One scan: events are hash-aggregated to (device, session, day, attributes), and the
    distinct counts and text maxima are worked out over those few rows. A busy device is
    reduced on the map side.
    """
    attributes = [c for c in ATTRIBUTES if c in events.columns]
    sums = sums or {}
    fine = [
        F.count(F.lit(1)).alias("total_events"),
        F.min("event_ts").alias("first_seen"),
        F.max("event_ts").alias("last_active"),
        *[F.sum(value).alias(name) for name, value in sums.items()],
    ]
    coarse = [
        F.sum("total_events").alias("total_events"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_active").alias("last_active"),
        *[F.max(c).alias(c) for c in attributes],
        *[F.sum(name).alias(name) for name in sums],
    ]
    if max_duration:
        fine.append(F.max("session_duration_seconds").alias("max_session_duration"))
        coarse.append(F.max("max_session_duration").alias("max_session_duration"))
    dated = events.withColumn("_day", F.to_date("event_ts"))
    per_day = dated.groupBy("device_id", "session_id", "_day", *attributes).agg(*fine)
    return per_day.groupBy("device_id").agg(
        *coarse,
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct("_day").alias("active_days"),
    )
