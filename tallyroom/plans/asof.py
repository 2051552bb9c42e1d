"""The range that a key lies in, by order: as-of joins without listing ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyroom.session import scratch_path


def in_ranges(keys: DataFrame, ranges: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the ``value`` of the one of ``ranges`` (lo, hi, value) that holds each of
    the distinct ``keys``; keys in none are left out. Ranges must be disjoint.

    Keys and ranges, one row each however wide a range is, are sorted into one order in
    ranges of the cluster's own choosing. Within each, a key takes the last range that
    began; the driver carries one range over each edge. Any type that has an order will do.
    """
    spark, path = keys.sparkSession, scratch_path(keys.sparkSession, "as-of")
    none = F.lit(None)
    kind = ranges.schema["lo"].dataType
    began = ranges.select(
        F.col("lo").alias("_at"), F.struct(F.col("lo"), F.col("hi"), F.col(value)).alias("_range")
    ).where("_at IS NOT NULL")
    asked = keys.select(F.col(key).cast(kind).alias("_at")).where("_at IS NOT NULL").distinct()
    asked = asked.withColumn("_range", none.cast(began.schema["_range"].dataType))
    # A range that begins at a key comes before it.
    order = [F.col("_at"), F.col("_range").isNull()]
    mixed = began.unionByName(asked)
    mixed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)

    ends = rows.groupBy("_part").agg(F.max_by("_range", F.when(F.col("_range").isNotNull(), F.col("_at"))).alias("_range"))
    carried, last = [], None
    for part, end in sorted(((r["_part"], r["_range"]) for r in ends.collect()), key=lambda r: r[0]):
        carried.append((part, last))
        last = end or last
    fields = [rows.schema["_part"], rows.schema["_range"]]
    carried = spark.createDataFrame(carried, type(rows.schema)(fields)).withColumnRenamed("_range", "_carried")

    so_far = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("_last", F.last("_range", ignorenulls=True).over(so_far)).where("_range IS NULL")
    held = held.join(F.broadcast(carried), "_part").withColumn("_last", F.coalesce("_last", "_carried"))
    held = held.where(F.col("_at") <= F.col("_last.hi"))
    return held.select(F.col("_at").alias(key), F.col(f"_last.{value}").alias(value))
