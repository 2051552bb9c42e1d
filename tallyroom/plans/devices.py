"""Reads of one device from tables that are clustered by device."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: The partition column of such a table names its number of buckets: device_bucket_256.
_NAME = re.compile(r"device_bucket_(\d+)")


def device_bucket(device: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(device), F.lit(buckets)).cast("int").alias(f"device_bucket_{buckets}")


def of_device(events: DataFrame, device_id: str) -> DataFrame:
    """The rows of one device. A table clustered by device (``sources.files.append_by_device``)
    opens the device's bucket alone."""
    mine = events.filter(F.col("device_id") == device_id)
    for name in events.columns:
        found = _NAME.fullmatch(name)
        if found:
            mine = mine.filter(F.col(name) == device_bucket(F.lit(device_id), int(found[1])))
    return mine
