"""Registered ingestion, profile and streaming jobs. Raw inputs are built by Spark
from the given tables, with a defect here and there."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from catalog import views
from catalog.events import E
from catalog.registry import Tables, query
from catalog.views import AS_OF
from tallyroom import clock, schema
from tallyroom.functions import as_double, as_int, mask_phone, normalize_phone, prop
from tallyroom.operators import feeds, profiles, rollup
from tallyroom.session import scratch_path
from tallyroom.sources import batches, export, files, ledger
from tallyroom.streaming import ingest, windows

BATCH_SIZE = 40


_LANDED: dict[tuple, str] = {}


def landed(t: Tables, kind: str, lines: DataFrame) -> str:
    """Gzipped text files with the given lines, as a source would leave them; landed once
    per application, data set and kind, as it is no part of the jobs that read them."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, kind)
    if key not in _LANDED or not files.table_exists(t.spark, _LANDED[key]):
        path = scratch_path(t.spark, "landed")
        lines.select("value").write.option("compression", "gzip").text(path)
        _LANDED[key] = path
    return _LANDED[key]


# Posted batches: forty consecutive event ids. Some events lack a category or a
# platform; some batches hold a nameless event, no event, or broken JSON.
BATCH_FIELDS = {
    "name": "CASE WHEN id % 997 = 0 THEN NULL ELSE name END",
    "category": "CASE WHEN id % 7 = 0 THEN '' ELSE category END",
    "timestamp": "CAST(event_ts AS STRING)",
    "user_id": "user_id",
    "device_id": "device_id",
    "session_id": "session_id",
    "session_duration_seconds": "CASE WHEN id % 6 = 0 THEN NULL ELSE session_duration_seconds END",
    "app_version": "app_version",
    "platform": "CASE WHEN id % 3 = 0 THEN platform END",
    "os_version": "os_version",
    "device_model": "device_model",
    "locale": "locale",
    "timezone": "timezone",
}


def batch_lines(events: DataFrame, *keep: str) -> DataFrame:
    cells = ", ".join(f"{text} AS {name}" for name, text in BATCH_FIELDS.items())
    event = F.concat(
        F.lit('{"properties":'), "properties", F.lit(","),
        F.expr(f"substring(to_json(struct({cells})), 2)"),
    )
    number = F.floor(F.col("id") / BATCH_SIZE)
    grouped = events.groupBy(number.alias("batch_no")).agg(
        F.concat_ws(",", F.transform(
            F.sort_array(F.collect_list(F.struct("id", event.alias("json")))), lambda x: x["json"]
        )).alias("events"),
        F.min_by("ip_address", "id").alias("ip"),
    )
    no = F.col("batch_no")
    forwarded = F.concat(F.lit('"x_forwarded_for":" ::ffff:'), "ip", F.lit(', 10.9.9.9",'))
    real = F.concat(F.lit('"x_real_ip":"'), "ip", F.lit('",'))
    line = F.concat(
        F.lit("{"),
        F.when(no % 3 == 0, forwarded).when(no % 3 == 1, real).otherwise(F.lit("")),
        F.lit('"remote_ip":"::1","received_at":"2024-01-31 00:00:00","events":['),
        F.when(no % 50 == 48, F.lit("")).otherwise(F.col("events")),
        F.when(no % 50 == 49, F.lit("")).otherwise(F.lit("]}")),
    )
    return grouped.select(line.alias("value"), *keep)


BATCHES_SQL = """WITH b AS (SELECT *, id // 40 AS batch_no FROM app_events),
  n AS (SELECT batch_no, arg_min(ip_address, id) AS ip, count(*) FILTER (id % 997 = 0) AS nameless
    FROM b GROUP BY 1),
  c AS (SELECT batch_no, CASE WHEN batch_no % 3 = 2 THEN '127.0.0.1' ELSE ip END AS ip,
    CASE WHEN batch_no % 50 = 49 THEN 'malformed' WHEN batch_no % 50 = 48 THEN 'no events'
      WHEN nameless > 0 THEN 'invalid event' END AS reason FROM n)
"""
INGESTED_SQL = """name,
  CASE WHEN id % 7 = 0 THEN 'engagement' ELSE category END AS category, properties, event_ts, user_id,
  device_id, session_id, CASE WHEN id % 6 = 0 THEN 0 ELSE session_duration_seconds END AS session_duration_seconds,
  app_version, CAST(NULL AS VARCHAR) AS build_number, 'ios' AS platform, os_version, device_model, locale, timezone,
  c.ip AS ip_address, TIMESTAMP '2024-01-31' AS created_at
  FROM b JOIN c USING (batch_no)"""


# Re-encoding JSON may drop trailing zeros, so the property bag is compared by value.
BAG_SQL = """properties->>'$.source' AS source, properties->>'$.date_range' AS date_range,
  CAST(properties->>'$.photos_scanned' AS INT) AS photos_scanned, properties->>'$.granted' AS granted,
  CAST(properties->>'$.revenue' AS DOUBLE) AS revenue"""
INGESTED_SQL = INGESTED_SQL.replace("properties", BAG_SQL)


def _open_bag(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "source": prop("source"),
            "date_range": prop("date_range"),
            "photos_scanned": as_int(prop("photos_scanned")),
            "granted": prop("granted"),
            "revenue": as_double(prop("revenue")),
        }
    ).drop("properties")


def _checked(t: Tables):
    path = landed(t, "batches", batch_lines(t.app_events))
    return batches.validate_batches(batches.read_event_batches(t.spark, path))


query(
    "validate_batches",
    lambda t: _checked(t).rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("batches")), E,
    f"{BATCHES_SQL} SELECT reason, count(*) AS batches FROM c WHERE reason IS NOT NULL GROUP BY 1",
)
query(
    "ingest_event_batches",
    lambda t: _open_bag(batches.ingest_event_batches(_checked(t).accepted, AS_OF).drop("id")), E,
    f"{BATCHES_SQL} SELECT CAST(NULL AS VARCHAR) AS country, {INGESTED_SQL} WHERE reason IS NULL",
)
query(
    "normalize_client_ip",
    lambda t: batches.normalize_client_ip(
        t.app_events.selectExpr(
            "id",
            "CASE WHEN id % 4 = 0 THEN concat(' ::ffff:', ip_address, ' , 1.2.3.4') WHEN id % 4 = 1 THEN '' END AS x_forwarded_for",
            "CASE WHEN id % 4 < 2 THEN '9.9.9.9' WHEN id % 4 = 2 THEN '::1' END AS x_real_ip",
            "concat('::ffff:', ip_address) AS remote_ip",
        )
    ).select("id", "ip_address"), E,
    """SELECT id, CASE id % 4 WHEN 0 THEN ip_address WHEN 1 THEN '9.9.9.9' WHEN 2 THEN '127.0.0.1'
    ELSE ip_address END AS ip_address FROM app_events""",
)
GEO = """SELECT e.id, e.ip_address, g.country FROM app_events e LEFT JOIN geo_ranges g
    ON split_part(ip_address, '.', 1)::BIGINT * 16777216 + split_part(ip_address, '.', 2)::BIGINT * 65536
      + split_part(ip_address, '.', 3)::BIGINT * 256 + split_part(ip_address, '.', 4)::BIGINT BETWEEN g.lo AND g.hi"""
query(
    "ip_to_country",
    lambda t: batches.ip_to_country(t.app_events.select("id", "ip_address", "country"), t.geo_ranges),
    E + " geo_ranges", GEO,
)
query(
    "ip_to_country_by_salted_key",
    lambda t: batches.ip_to_country(
        t.app_events.select("id", "ip_address", "country"), t.geo_ranges, small=False
    ), E + " geo_ranges", GEO,
)
# The same ranges as address keys, every fourth address written as a mapped IPv6 one.
query(
    "ip_to_country_by_address_key",
    lambda t: batches.ip_to_country(
        t.app_events.selectExpr(
            "id", "CASE WHEN id % 4 = 0 THEN concat('0:0::ffff:', lower(hex(CAST(split_part(ip_address, '.', 1) AS INT) * 256"
            " + CAST(split_part(ip_address, '.', 2) AS INT))), ':', lower(hex(CAST(split_part(ip_address, '.', 3) AS INT) * 256"
            " + CAST(split_part(ip_address, '.', 4) AS INT)))) ELSE ip_address END AS ip", "ip_address",
        ),
        t.geo_ranges.select(
            *[F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(c)), 8, "0")).alias(c) for c in ("lo", "hi")],
            "country",
        ), ip="ip",
    ).drop("ip"), E + " geo_ranges", GEO,
)

# Webhooks: one line per subscription event. In the sandbox some event types arrive
# without an event, as broken JSON, or with a price that is no number.

WEBHOOK_DEFECT = """CASE WHEN environment = 'SANDBOX' THEN CASE event_type
    WHEN 'PRODUCT_CHANGE' THEN 'no event' WHEN 'EXPIRATION' THEN 'malformed'
    WHEN 'CANCELLATION' THEN 'invalid event' END END"""


def webhook_lines(subscriptions: DataFrame) -> DataFrame:
    line = F.expr(f"""CASE COALESCE({WEBHOOK_DEFECT}, '')
      WHEN 'no event' THEN '{{"api_version":"1.0"}}' WHEN 'malformed' THEN '{{"event":{{"type"'
      ELSE to_json(struct(struct(event_type AS type, app_user_id, original_app_user_id, product_id,
        period_type, unix_millis(CAST(created_at AS TIMESTAMP)) AS purchased_at_ms,
        CASE WHEN period_type = 'TRIAL' THEN 0L ELSE unix_millis(CAST(created_at AS TIMESTAMP)) + 86400000L END AS expiration_at_ms,
        environment, CASE WHEN is_trial_conversion THEN true END AS is_trial_conversion,
        CASE WHEN {WEBHOOK_DEFECT} = 'invalid event' THEN 'free' ELSE CAST(price AS STRING) END AS price, currency,
        takehome_percentage) AS event)) END""")
    return subscriptions.select(line.alias("value"))


def _webhooks(t: Tables) -> batches.Checked:
    path = landed(t, "webhooks", webhook_lines(t.subscription_events))
    return batches.ingest_subscription_webhooks(
        batches.read_subscription_webhooks(t.spark, path), AS_OF
    )


query(
    "ingest_subscription_webhooks", lambda t: _webhooks(t)
    .accepted.drop("id", "raw_payload").withColumns(
        {c: F.col(c).cast("double") for c in ("price", "takehome_percentage")}
    ), "subscription_events",
    f"""SELECT event_type, app_user_id, original_app_user_id, product_id, '[]' AS entitlement_ids, period_type,
    created_at AS purchased_at, CASE WHEN period_type = 'TRIAL' THEN NULL ELSE created_at + INTERVAL 1 DAY END AS expiration_at,
    CAST(NULL AS VARCHAR) AS store, environment, is_trial_conversion, CAST(NULL AS VARCHAR) AS cancel_reason, CAST(price AS DOUBLE) AS price,
    currency, CAST(takehome_percentage AS DOUBLE) AS takehome_percentage, TIMESTAMP '2024-01-30 23:59:59' AS created_at
    FROM subscription_events WHERE ({WEBHOOK_DEFECT}) IS NULL""",
)
query(
    "rejected_webhooks", lambda t: _webhooks(t)
    .rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("lines")), "subscription_events",
    f"""SELECT {WEBHOOK_DEFECT} AS reason, count(*) AS lines FROM subscription_events
    WHERE reason IS NOT NULL GROUP BY 1""",
)

# Export: every event, photos twice, purchases without a country cut off. Half a month
# is stored already.

CUT = "(category = 'monetization' AND country IS NULL)"
STORED = "event_ts < TIMESTAMP '2024-01-16 12:00:00'"


def export_lines(events: DataFrame) -> DataFrame:
    copies = F.expr("CASE WHEN name = 'photo_captured' THEN array(0, 1) ELSE array(0) END")
    rows = events.withColumn("copy", F.explode(copies))
    line = F.expr(f"""CASE WHEN {CUT} THEN '{{"event_type": "cut' ELSE
      concat('{{"event_properties":', properties, ',', substring(to_json(struct(name AS event_type,
        CASE WHEN locale IS NULL THEN CAST(event_ts AS STRING) END AS event_time,
        CAST(event_ts AS STRING) AS server_received_time, user_id, device_id,
        CASE WHEN session_id IS NULL THEN 0 ELSE id END AS session_id, concat(app_version, '.', copy) AS app_version,
        os_version, device_model AS device_type, locale AS language, timezone)), 2)) END""")
    return rows.select(line.alias("value"))


def _sync(t: Tables) -> export.SyncResult:
    stored = t.app_events.filter(STORED.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    lines = export.read_export(t.spark, landed(t, "export", export_lines(t.app_events)))
    return export.sync_export(lines, stored, as_of=AS_OF)


query(
    "sync_export", lambda t: _open_bag(_sync(t).new_rows.drop("id", "created_at")), E,
    f"""SELECT name, 'engagement' AS category, {BAG_SQL}, event_ts, user_id, device_id,
    CASE WHEN session_id IS NULL THEN NULL ELSE CAST(id AS VARCHAR) END AS session_id, 0 AS session_duration_seconds,
    app_version || '.0' AS app_version, CAST(NULL AS VARCHAR) AS build_number, 'ios' AS platform, os_version, device_model,
    locale, timezone, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS ip_address FROM app_events WHERE NOT {CUT} AND NOT {STORED}""",
)
query(
    "sync_export_counts", lambda t: _sync(t).counts, E,
    f"""SELECT count(*) FILTER (NOT {CUT} AND NOT {STORED}) AS synced,
    count(*) FILTER (NOT {CUT} AND {STORED}) + count(*) FILTER (name = 'photo_captured') AS skipped,
    count(*) FILTER ({CUT}) AS errors FROM app_events""",
)
query(
    "sync_window",
    lambda t: clock.sync_window(AS_OF - timedelta(days=4), 7).apply(t.app_events, "event_ts")
    .groupBy(F.to_date("event_ts").alias("date")).agg(F.count(F.lit(1)).alias("events")), E,
    """SELECT CAST(event_ts AS DATE) AS date, count(*) AS events FROM app_events
    WHERE CAST(event_ts AS DATE) BETWEEN DATE '2024-01-19' AND DATE '2024-01-26' GROUP BY 1""",
)


def _csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "report-csv")
    rows = t.search_rows.select(
        "dim", "key", F.col("date").cast("string").alias("date"),
        F.concat(F.col("clicks").cast("string"), F.lit(", of "), F.col("impressions").cast("string")).alias("summary"),
    )
    rows.write.option("header", True).csv(path)
    return files.read_report_csv(t.spark, path)


query(
    "read_report_csv", _csv, "search_rows",
    """SELECT dim, key, CAST(date AS VARCHAR) AS date, clicks || ', of ' || impressions AS summary FROM search_rows""",
)

# Profiles.

KNOWN = "device_id email phone subscription_tier opted_in_marketing"


def _profiles(t: Tables) -> DataFrame:
    return files.align_schema(t.profiles, schema.PROFILES).select(*schema.PROFILES.names)


def _profile_changes(t: Tables) -> DataFrame:
    rows = t.subscription_events.selectExpr(
        "original_app_user_id AS device_id", "id AS seq",
        "CASE WHEN id % 3 = 0 THEN '' ELSE product_id END AS subscription_tier",
        "CASE WHEN id % 4 = 0 THEN concat('s', id, '@example.com') END AS email",
        "CASE WHEN id % 5 = 0 THEN is_trial_conversion END AS opted_in_marketing",
    )
    return files.align_schema(rows, schema.PROFILES)


query(
    "merge_profiles",
    lambda t: profiles.merge_profiles(_profiles(t), _profile_changes(t), AS_OF).select(*KNOWN.split()),
    "profiles subscription_events",
    """WITH c AS (SELECT original_app_user_id AS device_id,
      arg_max(product_id, id) FILTER (id % 3 <> 0) AS tier,
      arg_max('s' || id || '@example.com', id) FILTER (id % 4 = 0) AS mail,
      arg_max(is_trial_conversion, id) FILTER (id % 5 = 0) AS opted
      FROM subscription_events GROUP BY 1)
    SELECT COALESCE(p.device_id, c.device_id) AS device_id, COALESCE(mail, email) AS email, phone,
      COALESCE(tier, subscription_tier) AS subscription_tier, COALESCE(opted, opted_in_marketing) AS opted_in_marketing
    FROM profiles p FULL JOIN c ON p.device_id = c.device_id""",
)
query(
    "delete_profiles",
    lambda t: profiles.delete_profiles(
        t.profiles,
        t.subscription_events.filter("event_type = 'EXPIRATION'").select(F.col("app_user_id").alias("device_id")),
    ), "profiles subscription_events",
    """SELECT * FROM profiles WHERE device_id NOT IN (
      SELECT app_user_id FROM subscription_events WHERE event_type = 'EXPIRATION')""",
)


def _phone_changes(t: Tables) -> DataFrame:
    return t.subscription_events.filter("event_type IN ('INITIAL_PURCHASE', 'CANCELLATION')").selectExpr(
        "app_user_id AS device_id", "id AS seq",
        "CASE event_type WHEN 'CANCELLATION' THEN 'approved' ELSE 'sent' END AS kind",
        "CASE event_type WHEN 'INITIAL_PURCHASE' THEN concat('1 (212) ', 1000000 + id) END AS phone",
    )


query(
    "apply_phone_changes",
    lambda t: profiles.apply_phone_changes(_profiles(t), _phone_changes(t), AS_OF)
    .select("device_id", "phone", "phone_verified"), "profiles subscription_events",
    """WITH c AS (SELECT app_user_id AS device_id,
      max(id) FILTER (event_type = 'INITIAL_PURCHASE') AS sent, max(id) FILTER (event_type = 'CANCELLATION') AS ok
      FROM subscription_events GROUP BY 1)
    SELECT COALESCE(p.device_id, c.device_id) AS device_id,
      COALESCE('+1212' || (1000000 + sent), phone) AS phone,
      CASE WHEN ok IS NOT NULL AND (sent IS NULL OR ok > sent) THEN TRUE WHEN sent IS NOT NULL THEN FALSE END AS phone_verified
    FROM profiles p FULL JOIN c ON p.device_id = c.device_id WHERE p.device_id IS NOT NULL OR sent IS NOT NULL""",
)
# The same two jobs with every column of a profile.
NEVER = "CAST(NULL AS VARCHAR) AS {0}".format
UNKNOWN = "CAST(NULL AS BOOLEAN) AS {0}".format
MOMENTS = """CASE WHEN p.device_id IS NULL THEN TIMESTAMP '2024-01-30 23:59:59' END AS created_at,
      CASE WHEN c.device_id IS NOT NULL THEN TIMESTAMP '2024-01-30 23:59:59' END AS updated_at"""
query(
    "merge_profiles_all_columns",
    lambda t: profiles.merge_profiles(
        _profiles(t), _profile_changes(t).withColumns({
            "display_name": F.concat(F.lit("n"), F.col("seq") % 4), "rc_user_id": F.when(F.col("seq") % 6 == 0, F.col("device_id")),
            "opted_in_receipts": F.col("seq") % 7 == 0,
        }), AS_OF,
    ), "profiles subscription_events",
    f"""WITH c AS (SELECT original_app_user_id AS device_id,
      arg_max(product_id, id) FILTER (id % 3 <> 0) AS tier, max(original_app_user_id) FILTER (id % 6 = 0) AS rc,
      arg_max('s' || id || '@example.com', id) FILTER (id % 4 = 0) AS mail,
      arg_max(is_trial_conversion, id) FILTER (id % 5 = 0) AS opted,
      'n' || (max(id) % 4) AS display_name, max(id) % 7 = 0 AS receipts
      FROM subscription_events GROUP BY 1)
    SELECT COALESCE(p.device_id, c.device_id) AS device_id, rc AS rc_user_id, COALESCE(mail, email) AS email, phone,
      display_name, COALESCE(tier, subscription_tier) AS subscription_tier, {NEVER('preferred_contact')},
      COALESCE(opted, opted_in_marketing) AS opted_in_marketing, {UNKNOWN('opted_in_product_updates')},
      receipts AS opted_in_receipts, CASE WHEN p.device_id IS NULL THEN FALSE END AS email_verified,
      CASE WHEN p.device_id IS NULL THEN FALSE END AS phone_verified, {MOMENTS}
    FROM profiles p FULL JOIN c ON p.device_id = c.device_id""",
)
query(
    "apply_phone_changes_all_columns",
    lambda t: profiles.apply_phone_changes(_profiles(t), _phone_changes(t), AS_OF), "profiles subscription_events",
    f"""WITH c AS (SELECT app_user_id AS device_id,
      max(id) FILTER (event_type = 'INITIAL_PURCHASE') AS sent, max(id) FILTER (event_type = 'CANCELLATION') AS ok
      FROM subscription_events WHERE event_type IN ('INITIAL_PURCHASE', 'CANCELLATION') GROUP BY 1)
    SELECT COALESCE(p.device_id, c.device_id) AS device_id, {NEVER('rc_user_id')}, email,
      COALESCE('+1212' || (1000000 + sent), phone) AS phone, {NEVER('display_name')}, subscription_tier,
      {NEVER('preferred_contact')}, opted_in_marketing, {UNKNOWN('opted_in_product_updates')}, {UNKNOWN('opted_in_receipts')},
      CASE WHEN p.device_id IS NULL THEN FALSE END AS email_verified,
      CASE WHEN ok IS NOT NULL AND (sent IS NULL OR ok > sent) THEN TRUE WHEN sent IS NOT NULL THEN FALSE END AS phone_verified,
      {MOMENTS}
    FROM profiles p FULL JOIN c ON p.device_id = c.device_id WHERE p.device_id IS NOT NULL OR sent IS NOT NULL""",
)
query(
    "phone_numbers",
    lambda t: t.profiles.select(
        "device_id", normalize_phone(F.col("phone")).alias("phone"),
        mask_phone(normalize_phone(F.col("phone"))).alias("masked"),
    ), "profiles",
    """WITH n AS (SELECT device_id, regexp_replace(phone, '[^0-9+]', '', 'g') AS k FROM profiles),
    p AS (SELECT device_id, CASE WHEN starts_with(k, '+') THEN k ELSE '+1' || regexp_replace(k, '^1', '') END AS phone FROM n)
    SELECT device_id, phone, regexp_replace(phone, '(\\+[0-9]{1,3})([0-9]{3})([0-9]{3})([0-9]{4})', '\\1 (***) ***-\\4') AS masked FROM p""",
)
query(
    "align_schema",
    lambda t: _profiles(t).select(*KNOWN.split(), "rc_user_id", "phone_verified"), "profiles",
    f"SELECT {', '.join(KNOWN.split())}, CAST(NULL AS VARCHAR) AS rc_user_id, CAST(NULL AS BOOLEAN) AS phone_verified FROM profiles",
)

# Tables on the shared folder.


def _stored(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "events")
    files.append_events(t.app_events, path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy(F.col("event_date").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("device_id").alias("users")
    )


query(
    "append_events", _stored, E,
    """SELECT CAST(event_ts AS DATE) AS date, count(*) AS events, count(DISTINCT device_id) AS users
    FROM app_events GROUP BY 1""",
)


def _stats_columns(stats: DataFrame) -> DataFrame:
    return stats.select(
        F.col("date").cast("date").alias("date"), "total_events", "unique_devices", *rollup.COUNTERS,
        F.col("revenue").cast("double").alias("revenue"),
    )


STATS_SQL = """SELECT CAST(event_ts AS DATE) AS date, count(*) AS total_events,
    count(DISTINCT device_id) AS unique_devices,
    count(*) FILTER (name = 'photo_captured') AS photos_captured,
    count(*) FILTER (name = 'photo_deleted') AS photos_deleted,
    count(*) FILTER (name = 'paywall_viewed') AS paywall_views,
    count(*) FILTER (name = 'purchase_completed') AS purchases,
    CAST(COALESCE(sum(TRY_CAST(properties->>'$.revenue' AS DECIMAL(18,2))) FILTER (name = 'purchase_completed'), 0) AS DOUBLE) AS revenue
    FROM app_events GROUP BY 1"""


def _replaced(t: Tables) -> DataFrame:
    """Written over all days, then again for two of them."""
    path = scratch_path(t.spark, "daily-stats")
    rollup.write_daily_stats(rollup.rollup_daily_stats(t.app_events), path)
    days = t.spark.sql("SELECT explode(array(DATE '2024-01-05', DATE '2024-01-06')) AS date")
    rollup.write_daily_stats(rollup.rollup_daily_stats(t.app_events, days), path)
    return _stats_columns(t.spark.read.parquet(path))


query("replace_daily_stats", _replaced, E, STATS_SQL)

# Streams over the same inputs, run to the end of what has landed.


def _event_stream(t: Tables) -> DataFrame:
    # As a pattern, the path may be one file or a folder of files.
    path = f"{t.sf_dir.rstrip('/')}/event[s].parquet"
    raw = t.spark.readStream.schema(t.table("events").schema).parquet(path)
    name = f"events_{uuid.uuid4().hex}"
    raw.createOrReplaceTempView(name)
    return t.spark.sql(views.view_sql(E, name)).withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def _finish(running) -> None:
    running.awaitTermination()
    if running.exception():
        raise running.exception()


def _stream_ingest(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stream-ingest")
    stream = ingest.stream_event_batches(t.spark, landed(t, "batches", batch_lines(t.app_events)))
    _finish(ingest.start_ingest(
        stream, f"{root}/events", f"{root}/rejected", f"{root}/checkpoint", t.geo_ranges, AS_OF
    ))
    stored = ledger.committed(t.spark, f"{root}/events")
    return _open_bag(stored.drop("id", "event_date", ledger.FILE, *files.STAMP))


query(
    "stream_ingest", _stream_ingest, E + " geo_ranges",
    f"""{BATCHES_SQL} SELECT g.country, {INGESTED_SQL} LEFT JOIN geo_ranges g ON c.ip <> '127.0.0.1' AND
    split_part(c.ip, '.', 1)::BIGINT * 16777216 + split_part(c.ip, '.', 2)::BIGINT * 65536 BETWEEN g.lo AND g.hi
    WHERE reason IS NULL""",
)


def _two_sources(t: Tables) -> DataFrame:
    """Two streams, each with its own files and checkpoint, into the same tables."""
    root = scratch_path(t.spark, "stream-sources")
    for source in ("even", "odd"):
        own = t.app_events.filter(F.floor(F.col("id") / BATCH_SIZE) % 2 == int(source == "odd"))
        stream = ingest.stream_event_batches(t.spark, landed(t, f"batches-{source}", batch_lines(own)))
        _finish(ingest.start_ingest(
            stream, f"{root}/events", f"{root}/rejected", f"{root}/{source}", as_of=AS_OF, source=source
        ))
    return _events_and_ids(ledger.committed(t.spark, f"{root}/events"))


def _events_and_ids(stored: DataFrame) -> DataFrame:
    return stored.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("id").alias("ids")
    )


query(
    "stream_ingest_two_sources", _two_sources, E,
    f"""{BATCHES_SQL} SELECT CAST(event_ts AS DATE) AS event_date, count(*) AS events, count(*) AS ids
    FROM b JOIN c USING (batch_no) WHERE reason IS NULL GROUP BY 1""",
)

# Batches posted once, twice or three times, the copies in one file or in several.
POSTS = "1 + batch_no % 3"


def _regrouped(t: Tables) -> DataFrame:
    """A third of the files a micro-batch; after a lost checkpoint all files in one; closed days
    then compacted, and the checkpoint lost once more. There are as many files as tasks run at
    once, three at least."""
    third = max(1, t.spark.sparkContext.defaultParallelism // 3)
    root = scratch_path(t.spark, "stream-regrouped")
    lines = batch_lines(t.app_events, "batch_no").withColumn("copy", F.explode(F.expr(f"sequence(1, {POSTS})")))
    lines.repartition(3 * third, F.col("batch_no") + F.col("copy") % 2).select("value").write.text(f"{root}/posted")

    def run(checkpoint: str, files_per_trigger: int | None) -> None:
        stream = ingest.stream_event_batches(t.spark, f"{root}/posted", files_per_trigger)
        _finish(ingest.start_ingest(stream, f"{root}/events", f"{root}/rejected", f"{root}/{checkpoint}", as_of=AS_OF))

    run("first", third)
    run("second", None)
    closed = ledger.compact_days(t.spark, f"{root}/events", "main", (AS_OF - timedelta(days=7)).date())
    ledger.sweep(t.spark, f"{root}/events", closed)
    run("third", 2 * third)
    return _events_and_ids(ledger.committed(t.spark, f"{root}/events"))


query(
    "stream_ingest_regrouped", _regrouped, E,
    f"""{BATCHES_SQL} SELECT CAST(event_ts AS DATE) AS event_date, CAST(sum({POSTS}) AS BIGINT) AS events,
      CAST(sum({POSTS}) AS BIGINT) AS ids FROM b JOIN c USING (batch_no) WHERE reason IS NULL GROUP BY 1""",
)


def _searched_ingest(t: Tables) -> DataFrame:
    """Batches to a stored table to a feed page."""
    path = scratch_path(t.spark, "searched")
    files.append_events(batches.ingest_event_batches(_checked(t).accepted, AS_OF), path)
    found = feeds.search_events(t.spark.read.parquet(path), name="scan_started", limit=1_000_000)
    return found.rows.groupBy("device_id", "session_id").agg(F.count("id").alias("events"))


query(
    "search_ingested_events", _searched_ingest, E,
    f"""{BATCHES_SQL} SELECT device_id, session_id, count(*) AS events
    FROM b JOIN c USING (batch_no) WHERE reason IS NULL AND name = 'scan_started' GROUP BY 1, 2""",
)


def _windows(t: Tables, operator) -> DataFrame:
    root = scratch_path(t.spark, "stream-windows")
    counted = operator(_event_stream(t), late="60 days")
    _finish(windows.start_window_updates(counted, f"{root}/windows", f"{root}/checkpoint"))
    return windows.latest_windows(t.spark.read.parquet(f"{root}/windows"))


PER_MINUTE = """SELECT time_bucket(INTERVAL 1 MINUTE, event_ts) AS window_start,
    time_bucket(INTERVAL 1 MINUTE, event_ts) + INTERVAL 1 MINUTE AS window_end, count(*) AS events
    FROM app_events GROUP BY 1, 2"""
query("events_per_minute", lambda t: windows.events_per_minute(t.app_events), E, PER_MINUTE)
query("stream_events_per_minute", lambda t: _windows(t, windows.events_per_minute), E, PER_MINUTE)
ACTIVE_HOURS = """WITH w AS (SELECT device_id, time_bucket(INTERVAL 5 MINUTE, event_ts) - n * INTERVAL 5 MINUTE AS s
      FROM app_events, range(12) r(n))
    SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(DISTINCT device_id) AS active_users
    FROM w GROUP BY 1"""
query("active_last_hour", lambda t: windows.active_last_hour(t.app_events), E, ACTIVE_HOURS)


def _stream_hours(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stream-slides")
    _finish(windows.start_device_slides(_event_stream(t), f"{root}/slides", f"{root}/checkpoint"))
    return windows.hours_from_slides(t.spark.read.parquet(f"{root}/slides"))


query("stream_active_last_hour", _stream_hours, E, ACTIVE_HOURS)


def _stream_hour_counts(t: Tables) -> DataFrame:
    """Two files of events, a micro-batch each, then both again after a lost checkpoint."""
    root = scratch_path(t.spark, "stream-hours")
    events = t.app_events.select("device_id", F.col("event_ts").cast("timestamp").alias("event_ts"))
    events.repartition(2, F.hour("event_ts")).write.parquet(f"{root}/posted")
    for checkpoint, per_batch in (("first", 1), ("second", None)):
        stream = ingest.stream_event_files(t.spark, f"{root}/posted", events.schema, per_batch)
        _finish(windows.start_hour_counts(stream, f"{root}/hours", f"{root}/{checkpoint}"))
    return windows.hours_from_deltas(t.spark, f"{root}/hours")


query("stream_active_last_hour_by_deltas", _stream_hour_counts, E, ACTIVE_HOURS)


def _stream_dedup(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stream-dedup")
    repeated = _event_stream(t).withColumn(
        "copy", F.explode(F.expr("CASE WHEN id % 5 = 0 THEN array(0, 1) ELSE array(0) END"))
    )
    once = windows.stream_dedup(repeated, "60 days")
    _finish(ingest.start_append(once, f"{root}/events", f"{root}/checkpoint"))
    return t.spark.read.parquet(f"{root}/events").groupBy("device_id", "name").agg(
        F.count(F.lit(1)).alias("events")
    )


query(
    "stream_dedup", _stream_dedup, E,
    "SELECT device_id, name, count(DISTINCT event_ts) AS events FROM app_events GROUP BY 1, 2",
)


def _stream_rollup(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stream-rollup")
    _finish(ingest.start_daily_rollup(
        _event_stream(t), f"{root}/events", f"{root}/partials", f"{root}/checkpoint"
    ))
    partials = ledger.committed(t.spark, f"{root}/events", table=f"{root}/partials", table_day="date")
    return _stats_columns(rollup.stats_from_partials(partials))


query("stream_daily_rollup", _stream_rollup, E, STATS_SQL)
query(
    "daily_stats_from_partials",
    lambda t: _stats_columns(rollup.stats_from_partials(rollup.partial_stats(t.app_events))), E, STATS_SQL,
)
