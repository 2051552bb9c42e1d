"""Filtered event and subscription feeds, newest first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tallyroom import clock
from tallyroom.clock import Bounds
from tallyroom.functions import prop
from tallyroom.plans import DEEP, Page, beyond, from_offset, of_device, order_by, paged

# The columns of each feed.
RECENT_COLUMNS = [
    "name", "category", "properties", "event_ts", "created_at", "device_id", "session_id",
    "platform", "os_version", "device_model", "app_version", "locale", "timezone", "country",
]
SEARCH_COLUMNS = [
    "id", "name", "category", "properties", "event_ts", "device_id", "session_id", "platform",
    "os_version", "device_model", "app_version", "locale",
]
HISTORY_COLUMNS = [
    "id", "name", "category", "properties", "event_ts", "session_id",
    "session_duration_seconds", "app_version", "build_number",
]
SUBSCRIPTION_FEED_COLUMNS = [
    "event_type", "app_user_id", "product_id", "price", "currency", "period_type", "store",
    "environment", "created_at",
]
PURCHASE_COLUMNS = [
    "event_type", "product_id", "price", "currency", "period_type", "purchased_at",
    "expiration_at", "is_trial_conversion", "created_at",
]


def _newest(column: str = "event_ts"):
    return [order_by(column), F.col("id").desc()]


def _after(df: DataFrame, after: tuple | None, column: str = "event_ts") -> DataFrame:
    """Rows older than a page's last one, given by its time and id."""
    if after is None:
        return df
    moment, key = after
    return df.filter(beyond(column, moment, "desc", "id", key, "desc"))


def _page(found: DataFrame, after: tuple | None, limit: int, offset: int, deep: int) -> DataFrame:
    """A page of ``found``, newest first."""
    found, offset = from_offset(_after(found, after), "event_ts", "desc", "id", "desc", offset, deep)
    return paged(found, *_newest(), limit=limit, offset=offset)


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """Newest events by client time, falling back to arrival time."""
    when = F.coalesce("event_ts", "created_at").desc_nulls_first()
    top = paged(events, when, F.col("id").desc(), limit=limit)
    return top.select(*RECENT_COLUMNS)


def latest_events(events: DataFrame, limit: int = 20) -> DataFrame:
    top = paged(events, *_newest(), limit=limit)
    return top.select("name", "device_id", "event_ts", "properties")


def search_events(
    events: DataFrame,
    name: str | None = None,
    category: str | None = None,
    device_id: str | None = None,
    date=None,
    date_from=None,
    date_to=None,
    limit: int = 100,
    offset: int = 0,
    after: tuple | None = None,
    deep: int = DEEP,
) -> Page:
    """Events meeting all given conditions. ``date`` overrides ``date_from`` and
    ``date_to``; the last day counts in full. The total ignores paging. ``after``, the
    ``event_ts`` and ``id`` of a page's last row, asks for the page that follows. An offset
    above ``deep`` runs a job that finds where the page begins."""
    found = events
    for column, wanted in (("name", name), ("category", category)):
        if wanted:
            found = found.filter(F.col(column) == wanted)
    if device_id:
        found = of_device(found, device_id)
    if date:
        found = clock.one_day(date).apply(found, "event_ts")
    else:
        lo = clock.midnight(date_from) if date_from else None
        hi = datetime.combine(clock.as_date(date_to), clock.END_OF_DAY) if date_to else None
        found = Bounds(lo, hi).apply(found, "event_ts")
    rows = _page(found, after, limit, offset, deep).select(*SEARCH_COLUMNS)
    return Page(rows, found.agg(F.count(F.lit(1)).alias("total")))


def events_by_property(
    events: DataFrame,
    name: str,
    key: str,
    value: str,
    default: str | None = None,
    as_of: datetime | None = None,
    days: int = 30,
    limit: int = 100,
    offset: int = 0,
    after: tuple | None = None,
    deep: int = DEEP,
) -> Page:
    """Events of one type with a property value; ``default`` stands for a missing one;
    ``after`` and ``deep`` as in ``search_events``."""
    found_value = prop(key) if default is None else F.coalesce(prop(key), F.lit(default))
    found = clock.since(as_of, days).apply(events, "event_ts").filter(
        (F.col("name") == name) & (found_value == value)
    )
    rows = _page(found, after, limit, offset, deep)
    total = found.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("device_id").alias("unique_users")
    )
    return Page(rows.select("device_id", "event_ts", "properties"), total)


def profile_lookup(profiles: DataFrame, device_id: str) -> DataFrame:
    return profiles.filter(F.col("device_id") == device_id)


def user_event_history(events: DataFrame, device_id: str, limit: int = 200) -> DataFrame:
    """Newest events of one device."""
    mine = of_device(events, device_id)
    columns = [c for c in HISTORY_COLUMNS if c in events.columns]
    return paged(mine, *_newest(), limit=limit).select(*columns)


def user_purchase_history(subscriptions: DataFrame, user_id: str) -> DataFrame:
    """Subscription events of a user under the current or the original id."""
    mine = subscriptions.filter(
        (F.col("app_user_id") == user_id) | (F.col("original_app_user_id") == user_id)
    )
    columns = [c for c in PURCHASE_COLUMNS if c in subscriptions.columns]
    return mine.orderBy(order_by("created_at")).select(*columns)


def recent_subscription_events(
    subscriptions: DataFrame, as_of: datetime | None = None, days: int = 30, limit: int = 100
) -> DataFrame:
    """Newest subscription events of every environment."""
    recent = clock.since(as_of, days).apply(subscriptions, "created_at")
    columns = [c for c in SUBSCRIPTION_FEED_COLUMNS if c in subscriptions.columns]
    return paged(recent, *_newest("created_at"), limit=limit).select(*columns)
