"""Daily statistics, one replaceable row per date."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from tallyroom import clock, schema
from tallyroom.functions import as_money, prop
from tallyroom.sources.files import replace_partitions

# Events with a daily counter.
COUNTERS = {
    "photos_captured": "photo_captured", "photos_deleted": "photo_deleted",
    "paywall_views": "paywall_viewed", "purchases": "purchase_completed",
}


def rollup_daily_stats(events: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Counts, distinct devices and revenue per day. ``dates`` (column ``date``) limits
    the days and gives a zero row to one without events; stored events are pruned to
    those days by their partition column."""
    name = F.col("name")
    revenue = F.when(name == "purchase_completed", as_money(prop("revenue")))
    stored_day = clock.PARTITION in events.columns
    day = F.col(clock.PARTITION).cast("date") if stored_day else F.to_date("event_ts")
    dated = events.withColumn("date", day)
    if dates is not None:
        dates = dates.select("date").distinct()
        dated = dated.join(dates, "date", "left_semi")
    stats = dated.groupBy("date").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("device_id").alias("unique_devices"),
        *[F.count_if(name == event).alias(c) for c, event in COUNTERS.items()],
        F.sum(revenue).alias("revenue"),
    )
    if dates is not None:
        stats = dates.join(stats, "date", "left")
    measures = ["total_events", "unique_devices", *COUNTERS]
    return stats.select(
        "date",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in measures],
        F.coalesce("revenue", F.lit(0)).cast(schema.DAILY_STATS["revenue"].dataType)
        .alias("revenue"),
    )


def partial_stats(events: DataFrame) -> DataFrame:
    """What some events add to the statistics of their days: one row per day and device.
    Rows of any number of batches give the statistics of all (``stats_from_partials``)."""
    name = F.col("name")
    revenue = F.when(name == "purchase_completed", as_money(prop("revenue")))
    return events.groupBy(F.to_date("event_ts").alias("date"), "device_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        *[F.count_if(name == event).alias(c) for c, event in COUNTERS.items()],
        F.sum(revenue).alias("revenue"),
    )


def stats_from_partials(partials: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """``rollup_daily_stats`` from stored partial rows, of the ``dates`` given or all; the
    events themselves are not read."""
    if dates is not None:
        partials = partials.join(F.broadcast(dates.select("date").distinct()), "date", "left_semi")
    sums = ["total_events", *COUNTERS, "revenue"]
    per_device = partials.groupBy("date", "device_id").agg(*[F.sum(c).alias(c) for c in sums])
    stats = per_device.groupBy("date").agg(
        F.sum("total_events").alias("total_events"),
        F.count("device_id").alias("unique_devices"),
        *[F.sum(c).alias(c) for c in (*COUNTERS, "revenue")],
    )
    money = F.coalesce("revenue", F.lit(0)).cast(schema.DAILY_STATS["revenue"].dataType)
    return stats.select("date", "total_events", "unique_devices", *COUNTERS, money.alias("revenue"))


def compact_partials(partials: DataFrame, path: str, before) -> None:
    """Write the days before ``before``, a row per day and device, to ``path``, for readers
    to use in place of what the micro-batches of those days have left."""
    sums = ["total_events", *COUNTERS, "revenue"]
    closed = partials.filter(F.col("date") < F.lit(before)).groupBy("date", "device_id").agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    replace_partitions(closed, path, "date")


def write_daily_stats(stats: DataFrame, path: str, as_of: datetime | None = None) -> None:
    """Replace the rows of the dates in ``stats``, marked with the moment of the update."""
    moment = F.lit(clock.resolve(as_of).replace(tzinfo=timezone.utc)).cast("timestamp")
    replace_partitions(stats.withColumn("updated_at", moment), path, "date")
