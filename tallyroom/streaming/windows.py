"""Event-time windows over events, streaming or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyroom.sources import ledger
from tallyroom.sources.files import STAMP, replace_partitions, stamped

# The default trigger: everything that has landed, then stop.
AVAILABLE_NOW = {"availableNow": True}


def _time(events: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP; other time columns are read as UTC."""
    return events.withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def _windowed(events: DataFrame, window: Column, *measures: Column) -> DataFrame:
    counts = events.groupBy(window.alias("_w")).agg(*measures)
    return counts.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        *[c for c in counts.columns if c != "_w"],
    )


def events_per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per minute; on a stream, a minute closes ``late`` after its end."""
    timed = _time(events).withWatermark("event_ts", late)
    return _windowed(
        timed, F.window("event_ts", "1 minute"), F.count(F.lit(1)).alias("events")
    )


def active_last_hour(
    events: DataFrame, late: str = "10 minutes", slide_minutes: int = 5, rsd: float = 0.01
) -> DataFrame:
    """Devices active in the hour ending at every slide. The count is exact on a table;
    on a stream, where exact distinct counts are not supported, it is a sketch with
    relative error ``rsd`` and a state whose size does not depend on the devices."""
    if slide_minutes < 1 or 60 % slide_minutes:
        raise ValueError("slide_minutes must divide an hour")
    slide = f"{slide_minutes} minutes"
    hour = F.window("event_ts", "1 hour", slide)
    if events.isStreaming:
        timed = _time(events).withWatermark("event_ts", late)
        sketch = F.approx_count_distinct("device_id", rsd)
        return _windowed(timed, hour, sketch.alias("active_users"))
    return _exact_hours(_time(events), slide_minutes)


def _exact_hours(events: DataFrame, slide_minutes: int) -> DataFrame:
    """Exact distinct devices per sliding hour, without a distinct count."""
    return hours_from_slides(device_slides(events, slide_minutes), slide_minutes)


def device_slides(events: DataFrame, slide_minutes: int = 5) -> DataFrame:
    """(device_id, slide): the slides, numbered from the epoch, a device is active in."""
    slide = F.floor(F.unix_seconds(F.col("event_ts").cast("timestamp")) / (slide_minutes * 60))
    return events.select("device_id", slide.alias("slide")).distinct()


def hours_from_slides(slides: DataFrame, slide_minutes: int = 5) -> DataFrame:
    """Distinct devices per sliding hour from (device_id, slide), which may repeat.

    A device is kept once per slide; that slide opens the hours since the device's
    last one, so it is listed once for every hour it is active in. A device has at
    most one row per slide, however many events it sends.
    """
    per_hour = 60 // slide_minutes
    width = slide_minutes * 60
    slides = slides.select("device_id", F.col("slide").alias("_slide")).distinct()
    before = F.lag("_slide").over(Window.partitionBy("device_id").orderBy("_slide"))
    opens = F.greatest(F.col("_slide") - (per_hour - 1), F.col("_before") + 1)
    hours = slides.withColumn("_before", before).select(
        F.explode(F.sequence(opens, F.col("_slide"))).alias("_start")
    )
    counts = hours.groupBy("_start").agg(F.count(F.lit(1)).alias("active_users"))
    start = F.col("_start") * width
    return counts.select(
        F.timestamp_seconds(start).alias("window_start"),
        F.timestamp_seconds(start + 3600).alias("window_end"),
        "active_users",
    )


def stream_dedup(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drop repeats of (device, name, time) arriving within ``late`` of each other."""
    key = ["device_id", "name", "event_ts"]
    timed = _time(events)
    if not events.isStreaming:
        return timed.dropDuplicates(key)
    return timed.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(key)


def start_device_slides(
    events: DataFrame, path: str, checkpoint: str, slide_minutes: int = 5,
    trigger: dict | None = None, source: str = "main",
) -> StreamingQuery:
    """Store the slides each device is active in, micro-batch by micro-batch, by day.
    ``hours_from_slides`` over the table counts exactly what sketches estimate; the
    stream keeps no state, and late events count whenever they come."""
    if slide_minutes < 1 or 60 % slide_minutes:
        raise ValueError("slide_minutes must divide an hour")

    def store(batch: DataFrame, number: int) -> None:
        slides = device_slides(batch, slide_minutes)
        day = F.to_date(F.timestamp_seconds(F.col("slide") * (slide_minutes * 60)))
        dated = slides.withColumn("slide_date", day)
        replace_partitions(stamped(dated, source, number), path, "slide_date", *STAMP)

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def hour_deltas(new: DataFrame, stored: DataFrame, slide_minutes: int = 5) -> DataFrame:
    """(window_start, window_end, delta): by how much ``new`` slides (device_id, slide) raise
    the distinct devices of each sliding hour, given those ``stored`` for the same devices
    in the hours around them. Only hours that hold a new slide are listed."""
    after = hours_from_slides(new.unionByName(stored), slide_minutes)
    before = hours_from_slides(stored, slide_minutes).withColumn("active_users", -F.col("active_users"))
    keys = ["window_start", "window_end"]
    deltas = after.unionByName(before).groupBy(*keys).agg(F.sum("active_users").alias("delta"))
    return deltas.where("delta <> 0")


def start_hour_counts(
    events: DataFrame, path: str, checkpoint: str, slide_minutes: int = 5,
    trigger: dict | None = None, source: str = "main",
) -> StreamingQuery:
    """Keep exact distinct devices per sliding hour: ``hours_from_deltas`` adds up what each
    micro-batch has raised them by. A micro-batch reads the stored slides of its own devices
    on its own days and an hour around them, and no others. Slides and deltas go by one
    ledger at ``{path}/slides``, so a batch is in both or in none; events of
    ``ingest.stream_event_files`` are known by their file, of other streams a batch that
    runs again as it was. Deltas are named by batch, so these slides are not to be compacted."""
    if slide_minutes < 1 or 60 % slide_minutes:
        raise ValueError("slide_minutes must divide an hour")
    known, width = ledger.FILE in events.columns, slide_minutes * 60
    around = 60 // slide_minutes - 1

    def day(slide: Column) -> Column:
        return F.to_date(F.timestamp_seconds(slide * width))

    def store(batch: DataFrame, number: int) -> None:
        slide = F.floor(F.unix_seconds(F.col("event_ts").cast("timestamp")) / width).alias("slide")
        file = F.col(ledger.FILE) if known else F.lit(f"{source}/{number}").alias(ledger.FILE)
        rows = batch.where("device_id IS NOT NULL").select("device_id", slide, file).distinct()
        rows = rows.withColumn("slide_date", day(F.col("slide"))).persist()

        def write(fresh: DataFrame, name: str) -> None:
            new = fresh.select("device_id", "slide", "slide_date").distinct().persist()
            try:
                days = new.select(F.explode(F.array(*[
                    day(F.col("slide") + n) for n in (-around, 0, around)])).alias("day")).distinct()
                stored = ledger.committed(
                    batch.sparkSession, f"{path}/slides", [r[0] for r in days.collect()], "slide_date")
                if stored is None:
                    stored = new.limit(0)
                else:
                    stored = stored.where((F.col("ingest_batch") != name) | (F.col("ingest_source") != source))
                    stored = stored.join(new.select("device_id").distinct(), "device_id", "left_semi")
                slides = ["device_id", "slide"]
                deltas = hour_deltas(new.select(slides), stored.select(slides), slide_minutes)
                deltas = deltas.withColumn("window_date", F.to_date("window_start"))
                replace_partitions(stamped(deltas, source, name), f"{path}/deltas", "window_date", *STAMP)
                replace_partitions(stamped(new, source, name), f"{path}/slides", "slide_date", *STAMP)
            finally:
                new.unpersist()

        try:
            ledger.store(rows, f"{path}/slides", source, write, day="slide_date")
        finally:
            rows.unpersist()

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def hours_from_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Distinct devices per sliding hour of a table kept by ``start_hour_counts``: the deltas
    of the batches that its ledger names, a row an hour and batch."""
    named = ledger.lists(spark, f"{path}/slides", "slide_date").select(*STAMP).distinct()
    deltas = spark.read.parquet(f"{path}/deltas").withColumns({c: F.col(c).cast("string") for c in STAMP})
    counts = deltas.join(F.broadcast(named), STAMP, "left_semi").groupBy("window_start", "window_end").agg(
        F.sum("delta").alias("active_users")
    )
    return counts.where("active_users > 0")


def start_window_updates(
    windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
    source: str = "main",
) -> StreamingQuery:
    """Write every changed window under its day, its stream's name and its micro-batch
    number. A batch that is run again replaces its own files."""

    def store(batch: DataFrame, number: int) -> None:
        dated = batch.withColumn("window_date", F.to_date("window_start"))
        replace_partitions(stamped(dated, source, number), path, "window_date", *STAMP)

    return (
        windows.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def latest_windows(stored: DataFrame) -> DataFrame:
    """The last written state of every window of every stream."""
    keys = ["window_start", "window_end"]
    values = [c for c in stored.columns if c not in (*keys, "window_date", *STAMP)]
    last = stored.groupBy(*keys, "ingest_source").agg(
        *[F.max_by(c, "ingest_batch").alias(c) for c in values]
    )
    return last.drop("ingest_source")


def compact_windows(stored: DataFrame, path: str, before) -> None:
    """Write the last states of all windows of days before ``before`` to ``path``, one row
    a window, for readers to use in place of those days of the updates."""
    closed = stored.filter(F.col("window_date") < F.lit(before))
    dated = latest_windows(closed).withColumn("window_date", F.to_date("window_start"))
    replace_partitions(dated, path, "window_date")
