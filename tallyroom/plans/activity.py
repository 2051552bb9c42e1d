"""Days on which a device was active, as bits of a few longs.

A window has a known number of days, so a device's whole activity fits in
``ceil(days / 60)`` longs built by one hash aggregate: one shuffle of at most one
row per device and scan task, with no distinct and no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyroom.clock import Bounds

WORD = 60


def _words(bounds: Bounds) -> int:
    return -(-bounds.days // WORD)


def activity_words(events: DataFrame, bounds: Bounds, *measures: Column) -> DataFrame:
    """One row per device active in the window, with columns ``day_bits_0..``."""
    index = F.datediff(F.to_date("event_ts"), F.lit(bounds.lo.date()))
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    words = []
    for w in range(_words(bounds)):
        inside = (index >= w * WORD) & (index < (w + 1) * WORD)
        bit = F.call_function("shiftleft", one, index - w * WORD)
        words.append(F.bit_or(F.when(inside, bit).otherwise(none)).alias(f"day_bits_{w}"))
    return (
        bounds.apply(events, "event_ts")
        .groupBy("device_id")
        .agg(F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_active"),
             *words, *measures)
    )


def first_index(bounds: Bounds) -> Column:
    """Day number of the device's first active day in the window."""
    return F.datediff(F.to_date("first_seen"), F.lit(bounds.lo.date()))


def active_on(bounds: Bounds, day_index: Column) -> Column:
    """Whether the device was active on that day number; false outside the window."""
    hit = F.lit(False)
    for w in range(_words(bounds)):
        lo, hi = w * WORD, (w + 1) * WORD
        bit = F.getbit(F.col(f"day_bits_{w}"), F.pmod(day_index, F.lit(WORD)))
        hit = F.when((day_index >= lo) & (day_index < hi), bit == 1).otherwise(hit)
    return hit
