"""Continuous ingestion of landed batches into the events and quarantine tables.

A posted line is known by the file it stands in, its text and, if a file repeats it, by
which of the copies it is; so two equal posts are two batches, and a file that is read
again brings nothing new. Tables are kept with a ledger (``sources.ledger``): per day, the
files whose rows are there. A micro-batch reads the lists of its own days and leaves out
what another batch has brought, so a batch that runs again leaves the same rows, and so do
files that are grouped otherwise after a lost checkpoint. Files that both tables hold as a
whole are noted as such, and are known by that before a line of them is parsed. ``ledger.committed`` reads a
table, ``ledger.compact_days`` rewrites closed days. Jobs run to the end of what has landed
unless given another ``trigger``, such as ``{"processingTime": "1 minute"}``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyroom.operators.rollup import partial_stats
from tallyroom.sources import ledger
from tallyroom.sources.batches import (
    fits_broadcast, ingest_event_batches, ip_to_country, number_copies, parse_event_batches, with_reason,
)
from tallyroom.sources.files import STAMP, replace_partitions, stamped
from tallyroom.streaming.windows import AVAILABLE_NOW

#: The day a file of posted batches landed on; rejected lines are kept by it.
LANDED = "landed_date"
#: The text of a rejected batch, next to the events of the others.
REJECTED = "_rejected"


def stream_event_batches(spark: SparkSession, path: str, files_per_trigger: int | None = None):
    """Lines of files appearing in a folder, one JSON object each, with their file and the
    day it landed."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias(ledger.FILE),
        F.to_date("_metadata.file_modification_time").alias(LANDED),
    )


def stream_event_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None):
    """Events of Parquet files appearing in a folder, with their file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ledger.FILE, F.col("_metadata.file_path"))


def start_ingest(
    lines: DataFrame,
    events_path: str,
    quarantine_path: str,
    checkpoint: str,
    ranges: DataFrame | None = None,
    as_of: datetime | None = None,
    trigger: dict | None = None,
    source: str = "main",
) -> StreamingQuery:
    """Validate, flatten and locate every micro-batch of ``lines`` (see
    ``stream_event_batches``); rejects go to quarantine. Streams that share tables have
    ``source`` names of their own."""
    # Whether the ranges can be broadcast is settled once, not in every batch.
    small = None if ranges is None else fits_broadcast(ranges)

    def unfinished(files: DataFrame) -> Column | None:
        """A condition that lines of files that both tables hold as a whole do not meet; None
        if none of the files are left."""
        spark, days = files.sparkSession, [r[0] for r in files.select(LANDED).distinct().collect()]
        known = files
        for path in (events_path, quarantine_path):
            known = known.join(ledger.finished(spark, path, LANDED, days, source), [LANDED, ledger.FILE], "left_semi")
        known = [r[0] for r in known.select(ledger.FILE).collect()]
        return None if len(known) == files.count() else ~F.col(ledger.FILE).isin(known)

    def store(raw: DataFrame, number: int) -> None:
        # The files of one micro-batch, which the driver lists anyway.
        files = raw.select(LANDED, ledger.FILE).distinct().persist()
        try:
            left = unfinished(files)
            if left is not None:
                store_lines(raw.where(left))
                for path in (events_path, quarantine_path):
                    ledger.finish(files, path, source, LANDED)
        finally:
            files.unpersist()

    def store_lines(raw: DataFrame) -> None:
        # A rejected batch travels along as one row without an event, so that lines are
        # numbered and parsed once for both tables.
        checked = with_reason(parse_event_batches(number_copies(raw)))
        accepted, event = F.col("reason").isNull(), checked.schema["events"].dataType
        checked = checked.withColumns({
            "events": F.when(accepted, F.col("events")).otherwise(F.array(F.lit(None).cast(event.elementType))),
            REJECTED: F.when(~accepted, F.col("value")),
        })
        rows = ingest_event_batches(checked, as_of, keep=(ledger.FILE, LANDED, "reason", REJECTED))
        if ranges is not None:
            rows = ip_to_country(rows, ranges, small=small)
        # Days, files and rows are all taken from one evaluation.
        rows = rows.withColumn("event_date", F.to_date("event_ts")).persist()
        try:
            events = rows.where(accepted).drop(LANDED, "reason", REJECTED)
            rejected = rows.where(~accepted).select(F.col(REJECTED).alias("value"), "reason", ledger.FILE, LANDED)
            ledger.store(events, events_path, source, _into(events_path, source, "event_date"))
            ledger.store(rejected, quarantine_path, source, _into(quarantine_path, source, LANDED), day=LANDED)
        finally:
            rows.unpersist()

    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def _into(path: str, source: str, day: str):
    """Writes rows of a batch to the table at ``path``."""
    def write(rows: DataFrame, batch: str) -> None:
        replace_partitions(stamped(rows, source, batch), path, day, *STAMP)
    return write


def start_daily_rollup(
    events: DataFrame,
    events_path: str,
    partials_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    source: str = "main",
) -> StreamingQuery:
    """Append events, and add to ``partials_path`` what each micro-batch contributes to its
    days (see ``rollup.partial_stats``), so a late event reopens its day and no stored
    event is read again. ``rollup.stats_from_partials`` gives the statistics. Both tables
    go by the ledger of the events, so a batch is in both or in none.

    Events of ``stream_event_files`` are known by their file. Others are known by ``id`` if
    they have one: the ids that are stored for the days at hand are read. Without either,
    only a batch that runs again as it was is recognised."""
    known = ledger.FILE in events.columns
    key = ledger.FILE if known or "id" not in events.columns else "id"

    def store(batch: DataFrame, number: int) -> None:
        dated = batch.withColumn("event_date", F.to_date("event_ts"))
        if key == ledger.FILE and not known:
            dated = dated.withColumn(ledger.FILE, F.lit(f"{source}/{number}"))

        def write(fresh: DataFrame, name: str) -> None:
            fresh = fresh.persist()
            try:
                _into(events_path, source, "event_date")(fresh, name)
                partials = partial_stats(fresh)
                _into(partials_path, source, "date")(partials, name)
            finally:
                fresh.unpersist()

        dated.persist()
        try:
            ledger.store(dated, events_path, source, write, key)
        finally:
            dated.unpersist()

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def start_append(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream of events to a table partitioned by day; the file sink commits
    each micro-batch once."""
    dated = events.withColumn("event_date", F.to_date("event_ts"))
    return (
        dated.writeStream.format("parquet").partitionBy("event_date")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )
