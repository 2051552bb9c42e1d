"""Table schemas, column limits and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _I, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()
_TS = T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


EVENTS = _struct(
    id=_S, name=_S, category=_S, properties=_S, event_ts=_TS, user_id=_S, device_id=_S,
    session_id=_S, session_duration_seconds=_I, app_version=_S, build_number=_S, platform=_S,
    os_version=_S, device_model=_S, locale=_S, timezone=_S, country=_S, ip_address=_S,
    created_at=_TS,
)

SUBSCRIPTION_EVENTS = _struct(
    id=_S, event_type=_S, app_user_id=_S, original_app_user_id=_S, product_id=_S, entitlement_ids=_S,
    period_type=_S, purchased_at=_TS, expiration_at=_TS, store=_S, environment=_S,
    is_trial_conversion=_B, cancel_reason=_S, price=T.DecimalType(10, 2), currency=_S,
    takehome_percentage=T.DecimalType(5, 2), raw_payload=_S, created_at=_TS,
)

PROFILES = _struct(
    device_id=_S, rc_user_id=_S, email=_S, email_verified=_B, phone=_S, phone_verified=_B,
    display_name=_S, subscription_tier=_S, opted_in_marketing=_B, opted_in_product_updates=_B,
    opted_in_receipts=_B, preferred_contact=_S, created_at=_TS, updated_at=_TS,
)

DAILY_STATS = _struct(
    total_events=_L, unique_devices=_L, photos_captured=_L, photos_deleted=_L,
    paywall_views=_L, purchases=_L, revenue=T.DecimalType(38, 2), updated_at=_TS,
    date=T.DateType(),
)

# Longest text each stored column takes.
EVENT_LIMITS = {
    "name": 100, "category": 50, "user_id": 100, "device_id": 100, "session_id": 100,
    "app_version": 20, "build_number": 20, "platform": 20, "os_version": 20,
    "device_model": 50, "locale": 20, "timezone": 50,
}
SUBSCRIPTION_LIMITS = {
    "event_type": 100, "app_user_id": 255, "original_app_user_id": 255, "product_id": 100,
    "period_type": 50, "store": 50, "environment": 50, "cancel_reason": 100, "currency": 10,
}

# What a missing or empty field becomes.
EVENT_DEFAULTS = {"category": "engagement", "properties": "{}", "platform": "ios"}

# Fields of one event inside a posted batch. ``properties`` stays raw JSON text.
BATCH_EVENT = _struct(
    name=_S, category=_S, properties=_S, timestamp=_S, user_id=_S, device_id=_S, session_id=_S,
    session_duration_seconds=_I, app_version=_S, build_number=_S, platform=_S, os_version=_S,
    device_model=_S, locale=_S, timezone=_S,
)

EVENT_BATCH = T.StructType(
    [
        T.StructField("events", T.ArrayType(BATCH_EVENT)),
        T.StructField("x_forwarded_for", _S),
        T.StructField("x_real_ip", _S),
        T.StructField("remote_ip", _S),
        T.StructField("received_at", _S),
        T.StructField("_corrupt_record", _S),
    ]
)

SUBSCRIPTION_WEBHOOK = T.StructType(
    [
        T.StructField(
            "event",
            _struct(
                type=_S, app_user_id=_S, original_app_user_id=_S, product_id=_S,
                entitlement_ids=_S, period_type=_S, purchased_at_ms=_L, expiration_at_ms=_L,
                store=_S, environment=_S, is_trial_conversion=_B, cancel_reason=_S, price=_S,
                currency=_S, takehome_percentage=_S,
            ),
        ),
        T.StructField("_corrupt_record", _S),
    ]
)

EXPORT_LINE = T.StructType(
    [
        T.StructField(name, _S)
        for name in (
            "event_type", "event_properties", "event_time", "server_received_time", "user_id",
            "device_id", "session_id", "app_version", "platform", "os_version", "device_type",
            "language", "timezone", "_corrupt_record",
        )
    ]
)

# Landed third-party report payloads.
SERIES_REPORT = T.StructType(
    [
        T.StructField("xValues", T.ArrayType(_S)),
        T.StructField("series", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField(
            "seriesCollapsed",
            T.ArrayType(T.ArrayType(_struct(value=T.DoubleType()))),
        ),
    ]
)
EVENT_TOTALS_REPORT = T.StructType(
    [T.StructField("data", T.ArrayType(_struct(name=_S, totals=_L)))]
)
RETENTION_REPORT = T.StructType(
    [T.StructField("combinedRetention", T.ArrayType(T.DoubleType()))]
)
ISSUE = _struct(
    id=_S, title=_S, culprit=_S, level=_S, status=_S, count=_L, userCount=_L, firstSeen=_S,
    lastSeen=_S, shortId=_S, permalink=_S,
)
ISSUE_STATS = T.StructType([T.StructField("stats", T.ArrayType(T.ArrayType(_L)))])
REVIEW = _struct(
    id=_S, rating=_I, title=_S, body=_S, reviewerNickname=_S, createdDate=_S, territory=_S
)
SEARCH_ROW = T.StructType(
    [
        T.StructField("keys", T.ArrayType(_S)),
        T.StructField("clicks", _L),
        T.StructField("impressions", _L),
        T.StructField("ctr", T.DoubleType()),
        T.StructField("position", T.DoubleType()),
    ]
)
VERSION = _struct(id=_S, versionString=_S, appStoreState=_S, releaseType=_S, createdDate=_S)
