"""Consecutive numbers for the rows of a table, without a sort and without one task for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyroom.session import scratch_path

#: Bits of a row's place within its partition in Spark's increasing ids.
_PLACE_BITS = 33


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` on in no particular order. The rows are
    written once, each with its place in its partition, so numbers do not change when a
    lost task is run again; the driver adds up one count a partition."""
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright("_at", _PLACE_BITS)
    starts = []
    for number, count in sorted(rows.groupBy(part.alias("part")).count().collect()):
        starts.append((number, start))
        start += count
    starts = spark.createDataFrame(starts, "_part long, _start long")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    joined = rows.join(F.broadcast(starts), part == F.col("_part"))
    return joined.select(*df.columns, (F.col("_start") + place).alias(name))
