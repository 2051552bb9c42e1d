"""The device snapshot as a table that a stream keeps.

Devices are dealt into buckets by hash. A batch rewrites the buckets it touches and no
others: each becomes a new version, one file that appears as a whole, which also names the
last batch of every source in it. So a batch that runs again, after it got some buckets
written and others not, adds to the latter alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyroom.operators.snapshot import device_snapshot, merged_snapshot
from tallyroom.sources import ledger
from tallyroom.sources.files import table_exists
from tallyroom.streaming.windows import AVAILABLE_NOW

#: Buckets of a new table: a bucket is one file, so choose more for very many devices.
BUCKETS = 64
_SCHEMA = """device_id string, first_event timestamp, last_event timestamp, events long,
    source string, batch string, bucket int, version int"""


def _newest(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The newest version of some buckets or of all, marks of batches (no device_id) included."""
    folders = [path] if buckets is None else [f"{path}/bucket={b}" for b in buckets]
    folders = [f for f in folders if table_exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], _SCHEMA)
    rows = spark.read.schema(_SCHEMA).option("basePath", path).parquet(*folders)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """device_id, first_event, last_event, events of every device."""
    rows = _newest(spark, path).where("batch IS NULL")
    return rows.select("device_id", "first_event", "last_event", "events")


def add_batch(events: DataFrame, path: str, source: str, batch: str, buckets: int = BUCKETS) -> None:
    """Add what ``events`` bring, once per (source, batch). Batches of a source come one after
    the other; ``buckets`` stays the same for a table."""
    spark = events.sparkSession
    bucket = F.pmod(F.xxhash64("device_id"), F.lit(buckets)).cast("int")
    timed = events.withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    delta = device_snapshot(timed).withColumn("bucket", bucket).persist()
    try:
        touched = sorted(r[0] for r in delta.select("bucket").distinct().collect())
        current = _newest(spark, path, touched)
        marks = current.where("batch IS NOT NULL")
        done = marks.where((F.col("source") == source) & (F.col("batch") == batch))
        versions = {r[0]: r[1] for r in current.groupBy("bucket").agg(F.max("version")).collect()}
        skip = {r[0] for r in done.select("bucket").distinct().collect()}
        todo = [(b, versions.get(b, -1) + 1) for b in touched if b not in skip]
        if not todo:
            return
        open_ = F.broadcast(spark.createDataFrame(todo, "bucket int, _next int"))
        kept = current.where("batch IS NULL").select("device_id", "first_event", "last_event", "events")
        merged = merged_snapshot(kept, delta.drop("bucket")).withColumn("bucket", bucket)
        others = marks.where(F.col("source") != source).select("source", "batch", "bucket")
        own = open_.select(F.lit(source).alias("source"), F.lit(batch).alias("batch"), "bucket")
        rows = merged.unionByName(others, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
        rows = rows.join(open_, "bucket").withColumnRenamed("_next", "version")
        # One task a bucket, so its version is one file.
        rows.repartition(len(todo), "bucket").write.mode("append").partitionBy("bucket", "version").parquet(path)
        for number, version in todo:
            # The version before stays for readers that have just looked.
            ledger.delete_folder(spark, f"{path}/bucket={number}/version={version - 2}")
    finally:
        delta.unpersist()


def start_device_snapshot(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, source: str = "main",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the snapshot of a stream of events at ``path``. Events of
    ``ingest.stream_event_files`` are known by their file and day (a ledger beside the
    table), so files grouped otherwise after a lost checkpoint count once; of other streams
    a batch that runs again as it was is recognised."""
    known = ledger.FILE in events.columns

    def store(batch: DataFrame, number: int) -> None:
        if not known:
            add_batch(batch, path, source, f"n{number}", buckets)
            return
        dated = batch.withColumn("event_date", F.to_date("event_ts")).persist()
        try:
            ledger.store(dated, f"{path}_files", source, lambda rows, name: add_batch(rows, path, source, name, buckets))
        finally:
            dated.unpersist()

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )
