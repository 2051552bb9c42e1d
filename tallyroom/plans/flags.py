"""Exact distinct-device counts under many conditions in one pass.

Several ``countDistinct`` in one aggregate copy every row once per count. Here a
device is reduced to one row of booleans first; the counts are plain sums after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def device_flags(
    events: DataFrame, flags: dict[str, Column], *measures: Column, key: str = "device_id"
) -> DataFrame:
    """One row per device: each flag is true if any of its events meets the condition.
    A condition that is null counts as not met."""
    tests = [F.max(F.coalesce(test, F.lit(False))).alias(name) for name, test in flags.items()]
    return events.groupBy(key).agg(*tests, *measures)
