"""Event exports: gzipped JSON lines merged into the events already stored."""

from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyroom import clock, schema
from tallyroom.functions import or_default
from tallyroom.session import scratch_path
from tallyroom.sources.lines import parse_json_lines

KEY = ["device_id", "name", "event_ts"]


class SyncResult(NamedTuple):
    """``new_rows`` to append, and one row of ``synced, skipped, errors``."""

    new_rows: DataFrame
    counts: DataFrame


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Export lines with ``seq``, their source order as one number: file, by name, place of
    the block within it, and place of the line within the block."""
    lines = spark.read.text(path)
    named = [(name, i) for i, name in enumerate(sorted(lines.inputFiles()))]
    files = spark.createDataFrame(named, "_file string, _number long").withColumn("_file", _bare("_file"))
    block = F.col("_metadata.file_block_start")
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = lines.select("value", F.col("_metadata.file_path").alias("_path"), block.alias("_block"), line.alias("_line"))
    placed = placed.join(F.broadcast(files), _bare("_path") == F.col("_file"), "left")
    # A file that is listed under another name than it is read by comes after all others.
    unlisted = F.pmod(F.xxhash64("_path"), F.lit(10**9)) + len(named)
    placed = placed.withColumn("_number", F.coalesce("_number", unlisted))
    # A decimal, unlike a struct, can be the buffer of a hash aggregate.
    seq = _digits("_number", 10, 25) + _digits("_block", 15, 10) + _digits("_line", 10, 0)
    return placed.select("value", seq.cast("decimal(38,0)").alias("seq"))


def _bare(path: str) -> Column:
    """A path with one slash behind its scheme, however many are written there."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")


def _digits(column: str, digits: int, zeros: int) -> Column:
    return F.col(column).cast(f"decimal({digits},0)") * F.lit(Decimal(10**zeros))


def _parse(lines: DataFrame, now: Column) -> DataFrame:
    raw = parse_json_lines(lines, schema.EXPORT_LINE, "seq")

    def text(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    bag = F.coalesce(text("event_properties"), F.lit(schema.EVENT_DEFAULTS["properties"]))
    values = {
        "id": F.lit(None),
        "name": F.col("event_type"),
        "category": or_default(
            F.get_json_object(bag, "$.category"), schema.EVENT_DEFAULTS["category"]
        ),
        "properties": bag,
        "event_ts": F.coalesce(text("event_time"), text("server_received_time"))
        .try_cast("timestamp"),
        "session_id": F.nullif(text("session_id"), F.lit("0")),
        "session_duration_seconds": F.lit(0),
        "platform": or_default(F.col("platform"), schema.EVENT_DEFAULTS["platform"]),
        "device_model": F.col("device_type"),
        "locale": F.col("language"),
        "timezone": text("timezone"),
        "build_number": F.lit(None),
        "country": F.lit(None),
        "ip_address": F.lit(None),
        "created_at": now,
    }
    rows = raw.select(
        "seq",
        F.col("_corrupt_record").isNotNull().alias("_corrupt"),
        *[values.get(c, F.col(c)).cast(schema.EVENTS[c].dataType).alias(c)
          for c in schema.EVENTS.names],
    )
    fits = [F.coalesce(F.char_length(c) <= most, F.lit(True))
            for c, most in schema.EVENT_LIMITS.items()]
    present = [F.col(c).isNotNull() for c in KEY]
    valid = reduce(lambda a, b: a & b, [~F.col("_corrupt"), *present, *fits])
    # A number, as Spark prunes partitions by what an equation, not a flag, lets through.
    return rows.withColumn("_valid", valid.cast("int"))


def sync_export(lines: DataFrame, events: DataFrame, as_of: datetime | None = None) -> SyncResult:
    """Map export lines to events and keep those not stored yet under the same device,
    name and time; of equal lines the first is kept.

    Unreadable or invalid lines count as errors and the rest goes on. Lines are parsed once,
    into a scratch table, and reduced to one narrow row per key, its place in the export;
    what is stored on the export's days takes keys away, and only then are the rows that
    are left read in full. A stored table partitioned by day is opened at those days alone.
    """
    now = F.lit(clock.resolve(as_of).replace(tzinfo=timezone.utc))
    parsed = _parse(lines, now)
    path = scratch_path(lines.sparkSession, "export")
    parsed.write.parquet(path)
    parsed = lines.sparkSession.read.schema(parsed.schema).parquet(path)
    firsts = parsed.filter("_valid = 1").groupBy(*KEY).agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("_n")
    ).withColumn("_day", F.to_date("event_ts"))
    by_day = clock.PARTITION in events.columns
    day = F.col(clock.PARTITION).cast("date") if by_day else F.to_date(F.col("event_ts").cast("timestamp"))
    stored = events.select(
        "device_id", "name", F.col("event_ts").cast("timestamp").alias("event_ts"), day.alias("_day")
    )
    # One row per calendar day at most.
    days = firsts.select("_day").distinct()
    stored = stored.join(F.broadcast(days), "_day", "left_semi").select(*KEY, "_day").distinct()
    marked = firsts.join(stored.withColumn("_stored", F.lit(True)), [*KEY, "_day"], "left")
    marked = marked.withColumn("_new", F.col("_stored").isNull())
    fresh = parsed.filter("_valid = 1").join(marked.filter("_new").select("seq"), "seq", "left_semi")
    key = F.sha2(F.concat_ws("\u0001", *KEY), 256)
    new_rows = fresh.withColumn("id", key).select(*schema.EVENTS.names)

    found = marked.select(
        F.col("_new").cast("bigint").alias("synced"),
        F.when(F.col("_new"), F.col("_n") - 1).otherwise(F.col("_n")).alias("skipped"),
        F.lit(0).cast("bigint").alias("errors"),
    )
    bad = parsed.filter("_valid = 0").select(
        F.lit(0).cast("bigint").alias("synced"), F.lit(0).cast("bigint").alias("skipped"),
        F.lit(1).cast("bigint").alias("errors"),
    )
    counts = found.unionByName(bad).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("synced", "skipped", "errors")]
    )
    return SyncResult(new_rows, counts)
