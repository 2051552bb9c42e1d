"""Exact distinct devices from bitmaps: who was active on each day, a bit a device.

Every device has a number that never changes. A day is a few bitmaps of 32,768 devices each,
made of one batch's events and merged by OR with those of other batches, so a device counts
once whatever it sends. Distinct devices of any days are then ORs and counts of bits; no
event is read and nothing is counted distinct.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyroom import clock
from tallyroom.clock import Bounds
from tallyroom.functions import percent
from tallyroom.operators.retention import WEEKLY_PERIODS
from tallyroom.plans import single_row_to_rows
from tallyroom.plans.numbering import numbered
from tallyroom.sources.files import table_exists


def extend_devices(spark: SparkSession, path: str, events: DataFrame) -> DataFrame:
    """The table (device_id, number) at ``path`` with the devices that ``events`` add. Known
    devices keep their numbers; running it again adds none. One job at a time may extend it."""
    new, start = events.select("device_id").where("device_id IS NOT NULL").distinct(), 0
    if table_exists(spark, path):
        known = spark.read.parquet(path)
        new = new.join(known, "device_id", "left_anti")
        start = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    numbered(new, "number", start).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def day_bitmaps(events: DataFrame, devices: DataFrame) -> DataFrame:
    """(date, bucket, devices): the bitmaps that some events make. Each device is looked up
    once a day, however many events it sends."""
    active = events.select(F.to_date("event_ts").alias("date"), "device_id").distinct()
    place = F.col("number") + 1
    return active.join(devices, "device_id").groupBy("date", F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("devices")
    )


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps of any number of batches as one a day and bucket."""
    return bitmaps.groupBy("date", "bucket").agg(F.bitmap_or_agg("devices").alias("devices"))


def closed_history(bitmaps: DataFrame, before: date) -> DataFrame:
    """``merged_bitmaps`` with all days before ``before`` as one, dated the day before it; it
    answers whatever asks for days from ``before`` on and for the whole history."""
    last = F.lit(before - timedelta(days=1))
    return merged_bitmaps(bitmaps.withColumn("date", F.least("date", F.when(F.col("date") < F.lit(before), last))))


def _within(lo: date | None = None, hi: date | None = None) -> Column:
    """Whether the day lies in [lo, hi)."""
    test = F.lit(True)
    if lo is not None:
        test = test & (F.col("date") >= F.lit(lo))
    if hi is not None:
        test = test & (F.col("date") < F.lit(hi))
    return test


def _counts(bitmaps: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """One row: the number of devices active on any of the days of each set. Buckets are
    disjoint devices, so their counts are added."""
    ors = [F.bitmap_count(F.bitmap_or_agg(F.when(days, F.col("devices")))).alias(name) for name, days in sets.items()]
    per_bucket = bitmaps.groupBy("bucket").agg(*ors)
    return per_bucket.agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in sets])


def daily_active_users_from_bitmaps(bitmaps: DataFrame, bounds: Bounds) -> DataFrame:
    """``events.daily_active_users`` for a window of whole days."""
    days = merged_bitmaps(bounds.apply(bitmaps, "date"))
    return days.groupBy("date").agg(F.sum(F.bitmap_count("devices")).alias("users")).orderBy("date")


def active_users_from_bitmaps(bitmaps: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """The distinct counts of ``events.active_users``: dau, dau_yesterday, dau_change, wau,
    mau, total_users and new_users_today."""
    today = clock.resolve(as_of).date()

    def since(days: int) -> Column:
        return _within(today - timedelta(days=days))
    counts = _counts(bitmaps, {
        "dau": since(0), "dau_yesterday": _within(today - timedelta(days=1), today), "wau": since(7),
        "mau": since(30), "total_users": F.lit(True), "_before": _within(hi=today),
    })
    dau, before = F.col("dau"), F.col("dau_yesterday")
    return counts.select(
        "dau", "dau_yesterday", percent(dau - before, before, 1).alias("dau_change"), "wau", "mau", "total_users",
        (F.col("total_users") - F.col("_before")).alias("new_users_today"),
    )


def weekly_cohort_retention_from_bitmaps(
    bitmaps: DataFrame, as_of: datetime | None = None, weeks: int = 4, periods: tuple[int, ...] = WEEKLY_PERIODS,
) -> DataFrame:
    """``retention.weekly_cohort_retention``. A cohort is who was active before the end of its
    week less who was before its start, so what it shares with a day follows from counts of
    ORs: of either history with that day and without."""
    now = clock.resolve(as_of)
    today = now.date()
    sets, rows = {}, []
    for i in reversed(range(weeks)):
        end = today - timedelta(days=7 * i)
        start = end - timedelta(days=7)
        for name, day in ((f"_start_{i}", start), (f"_end_{i}", end)):
            sets[name] = _within(hi=day)
        size = F.col(f"_end_{i}") - F.col(f"_start_{i}")
        row = {"week": F.lit(i + 1), "cohort_start": F.lit(start), "cohort_size": size}
        for p in periods:
            day = end + timedelta(days=p - 1)
            if clock.midnight(day) + timedelta(days=1) > now:
                row[f"day{p}"] = F.lit(None).cast("double")
                continue
            for name, cut in ((f"_start_{i}", start), (f"_end_{i}", end)):
                sets[f"{name}_{p}"] = _within(hi=cut) | _within(day, day + timedelta(days=1))
            # |end and day| - |start and day|, as |a and d| = |a| + |d| - |a or d|.
            kept = size - F.col(f"_end_{i}_{p}") + F.col(f"_start_{i}_{p}")
            row[f"day{p}"] = F.try_divide(kept.cast("double"), size.cast("double")) * 100
        rows.append(row)
    return single_row_to_rows(_counts(bitmaps, sets), rows)
