"""Posted event batches and subscription webhooks.

A batch is one JSON line, so whether all of its events are valid is decided within
the row: no grouping, and the same code serves batch and streaming input.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyroom import clock, schema
from tallyroom.functions import address_key, client_ip, ipv4_number, or_default
from tallyroom.plans.asof import in_ranges
from tallyroom.session import scratch_path
from tallyroom.sources.lines import parse_json_lines

# Range tables up to this size are broadcast; larger ones are joined by order.
GEO_BROADCAST_BYTES = 64 << 20
IP_LENGTH = 45
COPY_BLOCK = 1000


class Checked(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def read_event_batches(spark: SparkSession, path: str) -> DataFrame:
    """Landed batches, one JSON object per line."""
    return parse_event_batches(spark.read.text(path))


def parse_event_batches(lines: DataFrame) -> DataFrame:
    """Text lines (``value``) to batches, next to the other columns of ``lines``; an
    unreadable line keeps its text in ``_corrupt_record``."""
    return parse_json_lines(lines, schema.EVENT_BATCH, *lines.columns)


def number_copies(lines: DataFrame) -> DataFrame:
    """``lines`` with ``line_copy``, which tells the equal lines of a file apart: 1, 2, 3 …

    Which of them has which number does not matter, so they are counted, not sorted. A line
    that a file repeats very often is dealt out in blocks of COPY_BLOCK.
    """
    counted = lines.groupBy(*lines.columns).agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) DIV {COPY_BLOCK})")))
    few = blocks.where(F.col("_n") <= COPY_BLOCK)
    many = blocks.where(F.col("_n") > COPY_BLOCK).repartition("_block", *lines.columns)
    first, size = F.col("_block") * COPY_BLOCK, F.lit(COPY_BLOCK)
    copies = F.sequence(first + 1, F.least(first + size, F.col("_n")))
    return few.unionAll(many).select(*lines.columns, F.explode(copies).alias("line_copy"))


def _fits(limits: dict[str, int], field) -> list[Column]:
    return [
        F.coalesce(F.char_length(field(name)) <= most, F.lit(True)) for name, most in limits.items()
    ]


def _valid_event(event: Column) -> Column:
    """Required fields are present, text fits, and the time, if given, can be read."""
    given = F.nullif(event["timestamp"], F.lit(""))
    tests = [
        event["name"].isNotNull(),
        event["device_id"].isNotNull(),
        given.isNull() | given.try_cast("timestamp").isNotNull(),
        *_fits(schema.EVENT_LIMITS, lambda name: event[name]),
    ]
    return reduce(lambda a, b: a & b, tests)


def _request_ip() -> Column:
    return client_ip(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("remote_ip"))


def with_reason(raw: DataFrame) -> DataFrame:
    """Batches with the ``reason`` why they are rejected, null for those that are accepted."""
    ip_fits = F.coalesce(F.char_length(_request_ip()) <= IP_LENGTH, F.lit(True))
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed"))
        .when(F.coalesce(F.size("events"), F.lit(0)) <= 0, F.lit("no events"))
        .when(~F.forall("events", _valid_event), F.lit("invalid event"))
        .when(~ip_fits, F.lit("invalid address"))
    )
    return raw.withColumn("reason", reason)


def validate_batches(raw: DataFrame) -> Checked:
    """All or nothing per batch: one bad event rejects its whole batch. Rejected
    batches carry a ``reason``."""
    checked = with_reason(raw)
    return Checked(
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def normalize_client_ip(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ip_address", _request_ip())


def ingest_event_batches(
    raw: DataFrame, as_of: datetime | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Accepted batches to one row per event with defaults filled in, and the ``keep``
    columns of their batch.

    ``id`` is a hash of the batch text and the event's place in it, stable when a lost
    task is run again. Where the file of a line and the number of its copy there are known
    (``ingest_file``, ``line_copy``) the hash is over these as well.
    """
    now = F.lit(clock.resolve(as_of).replace(tzinfo=timezone.utc))
    arrived = F.coalesce(F.col("received_at").try_cast("timestamp"), now)
    where = [c for c in ("ingest_file", "line_copy") if c in raw.columns]
    rows = normalize_client_ip(raw).select(
        F.sha2(F.concat_ws("\n", *where, "value"), 256).alias("_batch"),
        *keep,
        "ip_address",
        arrived.alias("created_at"),
        F.posexplode("events").alias("_pos", "_e"),
    )
    event = F.col("_e")
    # A falsy property bag is an empty one.
    bag = F.when(event["properties"].isin("", "0", "false"), F.lit(None)).otherwise(
        event["properties"]
    )
    given = F.nullif(event["timestamp"], F.lit("")).try_cast("timestamp")
    values = {
        "id": F.concat_ws(":", "_batch", "_pos"),
        "category": or_default(event["category"], schema.EVENT_DEFAULTS["category"]),
        "properties": F.coalesce(bag, F.lit(schema.EVENT_DEFAULTS["properties"])),
        "event_ts": F.coalesce(given, F.col("created_at")),
        "session_duration_seconds": or_default(event["session_duration_seconds"], 0),
        "platform": or_default(event["platform"], schema.EVENT_DEFAULTS["platform"]),
        "country": F.lit(None).cast("string"),
        "ip_address": F.col("ip_address"),
        "created_at": F.col("created_at"),
    }
    return rows.select(
        *[values.get(c, event[c]).cast(schema.EVENTS[c].dataType).alias(c)
          for c in schema.EVENTS.names],
        *keep,
    )


#: Bits below the blocks that ranges are listed under: a range goes to the finest level whose
#: blocks are as wide as itself, so it touches two of them at most.
_LEVELS = (16, 24, 32)


def _listed(ranges: DataFrame) -> DataFrame:
    """IPv4 ranges with their level and block, in one row or two."""
    lo, hi = F.col("lo").cast("bigint"), F.col("hi").cast("bigint")
    width = hi - lo + 1
    level = F.lit(_LEVELS[-1])
    for bits in reversed(_LEVELS[:-1]):
        level = F.when(width <= 1 << bits, F.lit(bits)).otherwise(level)
    rows = ranges.select(lo.alias("_lo"), hi.alias("_hi"), "country", level.alias("_level"))
    first, last = (F.call_function("shiftright", F.col(c), F.col("_level")) for c in ("_lo", "_hi"))
    return rows.withColumn("_block", F.explode(F.array_distinct(F.array(first, last))))


def fits_broadcast(ranges: DataFrame, most_bytes: int = GEO_BROADCAST_BYTES) -> bool:
    """Whether the ranges, as they are broadcast, take ``most_bytes`` at most: three longs
    and the country's text a row. A job; streams ask once. Ranges of address keys (text, see
    ``functions.address_key``) are joined by order and never broadcast."""
    if ranges.schema["lo"].dataType == T.StringType():
        return False
    size = F.sum(F.lit(24) + F.coalesce(F.octet_length("country"), F.lit(0)))
    return (_listed(ranges).agg(size).first()[0] or 0) <= most_bytes


def ip_to_country(
    events: DataFrame,
    ranges: DataFrame,
    ip: str = "ip_address",
    country: str = "country",
    small: bool | None = None,
    salts: int = 8,
) -> DataFrame:
    """Country of an address from disjoint ``lo, hi, country`` ranges of any width; null for
    the loopback, other addresses and gaps. Ranges are IPv4 numbers, or address keys
    (``functions.address_key``), which cover IPv4 and IPv6.

    Range tables that fit (``fits_broadcast``, asked here unless the caller passes
    ``small``) are broadcast: ranges are listed by blocks about as wide as themselves, and
    every level is an equi-join. Otherwise the distinct addresses, stored once, and the ranges
    are brought into one order (``plans.asof``), and events take what their address has found,
    by its text and a salt, as one address may send most of them.
    """
    kept = [c for c in events.columns if c != country]
    if fits_broadcast(ranges) if small is None else small:
        given = F.when(F.col(ip) != "127.0.0.1", F.col(ip))
        found = events.drop(country).withColumn("_ip", ipv4_number(given))
        listed, countries = _listed(ranges), []
        for level in _LEVELS:
            names = {c: f"{c}_{level}" for c in ("_lo", "_hi", "_block", "country")}
            side = listed.where(F.col("_level") == level).drop("_level").withColumnsRenamed(names)
            match = (F.shiftright("_ip", level) == F.col(f"_block_{level}")) & F.col("_ip").between(
                F.col(f"_lo_{level}"), F.col(f"_hi_{level}"))
            found = found.join(F.broadcast(side), match, "left")
            countries.append(f"country_{level}")
        return found.select(*kept, F.coalesce(*countries).alias(country))

    # An address is parsed once, however many rows have it; rows meet what it has found by its text.
    asked = events.select(F.col(ip).alias("_ip")).distinct()
    path = scratch_path(events.sparkSession, "addresses")
    asked.write.parquet(path)
    asked = events.sparkSession.read.schema("_ip string").parquet(path).where("_ip <> '127.0.0.1'")
    text = ranges.schema["lo"].dataType == T.StringType()
    asked = asked.select("_ip", (address_key if text else ipv4_number)(F.col("_ip")).alias("_key"))
    sides = ranges.select("lo", "hi", F.col("country").alias("_country"))
    located = asked.join(in_ranges(asked, sides, "_key", "_country"), "_key")
    located = located.select(F.col("_ip").alias("_key"), "_country")
    # A row without an address matches nothing; the salt keeps those rows spread out too.
    keyed = events.drop(country).withColumns(
        {"_ip": F.col(ip), "_salt": F.pmod(F.xxhash64(*kept), F.lit(salts)).cast("int")}
    )
    copies = located.withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    match = (F.col("_ip") == F.col("_key")) & (F.col("_salt") == F.col("_copy"))
    return keyed.join(copies, match, "left").select(*kept, F.col("_country").alias(country))


def read_subscription_webhooks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def ingest_subscription_webhooks(lines: DataFrame, as_of: datetime | None = None) -> Checked:
    """Webhook lines (``value``) to subscription events. Lines without an event, or
    with one that does not fit the table, are rejected with a ``reason``."""
    rows = parse_json_lines(lines, schema.SUBSCRIPTION_WEBHOOK, "value").select(
        "value", F.col("event").alias("_e"), F.col("_corrupt_record").alias("_corrupt")
    )
    event = F.col("_e")

    def moment(field: str) -> Column:
        return F.timestamp_millis(F.nullif(event[field], F.lit(0).cast("bigint")))

    def number(field: str, dtype: str) -> tuple[Column, Column]:
        value = event[field].try_cast(dtype)
        return value, event[field].isNull() | value.isNotNull()

    price, price_ok = number("price", "decimal(10,2)")
    kept, kept_ok = number("takehome_percentage", "decimal(5,2)")
    now = F.lit(clock.resolve(as_of).replace(tzinfo=timezone.utc))
    values = {
        "id": F.sha2("value", 256),
        "event_type": event["type"],
        "entitlement_ids": F.coalesce(F.nullif(event["entitlement_ids"], F.lit("")), F.lit("[]")),
        "purchased_at": moment("purchased_at_ms"),
        "expiration_at": moment("expiration_at_ms"),
        "is_trial_conversion": F.coalesce(event["is_trial_conversion"], F.lit(False)),
        "price": price,
        "takehome_percentage": kept,
        "raw_payload": F.col("value"),
        "created_at": now,
    }
    fields = {f.name for f in schema.SUBSCRIPTION_WEBHOOK["event"].dataType}
    source = {"event_type": "type"}
    limits = _fits(schema.SUBSCRIPTION_LIMITS, lambda name: event[source.get(name, name)])
    sound = reduce(lambda a, b: a & b, [event["type"].isNotNull(), price_ok, kept_ok, *limits])
    reason = (
        F.when(F.col("_corrupt").isNotNull(), F.lit("malformed"))
        .when(event.isNull(), F.lit("no event"))
        .when(~sound, F.lit("invalid event"))
    )
    checked = rows.withColumn("reason", reason)
    accepted = checked.filter(F.col("reason").isNull()).select(
        *[(values[c] if c in values else event[c] if c in fields else F.lit(None))
          .cast(schema.SUBSCRIPTION_EVENTS[c].dataType).alias(c)
          for c in schema.SUBSCRIPTION_EVENTS.names]
    )
    return Checked(accepted, checked.filter(F.col("reason").isNotNull()).select("value", "reason"))
