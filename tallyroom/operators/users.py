"""User lists, segments and drill-downs, all keyed on the device."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyroom import clock
from tallyroom.clock import ALL_TIME, Bounds, instant
from tallyroom.functions import as_money, prop
from tallyroom.functions.counts import n_rows
from tallyroom.plans import (
    DEEP, Page, beyond, device_flags, device_rollup, device_totals, from_offset, latest_per_key, of_device,
    order_by, paged,
)

# What lists may be sorted by.
USER_SORTS = {
    "last_active": "last_active", "first_seen": "first_seen", "events": "total_events",
    "purchases": "purchase_count",
}
SEGMENT_SORTS = {
    "last_seen": "last_active", "first_seen": "first_seen", "events_count": "total_events",
}

# Funnel step names and the events behind them.
STEP_EVENTS = {
    "app_opened": "app_opened", "permission_granted": "permission_result",
    "first_photo": "photo_captured", "first_scan": "scan_started",
    "paywall_viewed": "paywall_viewed", "subscription_started": "subscription_started",
}


# A page is broadcast back to the events up to this many devices: a few MB, as its
# columns are an id, a count and two times.
PAGE_BROADCAST_ROWS = 50_000


def user_stats(events: DataFrame, bounds: Bounds = ALL_TIME) -> DataFrame:
    """First and last activity, counts and attributes of every device."""
    return device_rollup(bounds.apply(events, "event_ts"))


def _status(stats: DataFrame, now: datetime) -> Column:
    active = F.col("last_active") >= instant(stats, "last_active", now - timedelta(days=7))
    gone = F.col("last_active") < instant(stats, "last_active", now - timedelta(days=30))
    return (
        F.when(F.col("purchase_count") > 0, F.lit("subscriber"))
        .when(active, F.lit("active"))
        .when(gone, F.lit("churned"))
        .otherwise(F.lit("inactive"))
    )


def users_with_purchases(
    events: DataFrame, bounds: Bounds, as_of: datetime | None = None
) -> DataFrame:
    """``user_stats`` plus purchases, revenue, photos and a status. The purchase and
    photo counts ride along in the same aggregation, so nothing is joined."""
    name = F.col("name")
    bought = name == "purchase_completed"
    stats = device_rollup(
        bounds.apply(events, "event_ts"),
        {
            "purchase_count": F.when(bought, 1).otherwise(0),
            "total_revenue": F.when(bought, as_money(prop("revenue"))),
            "photos_captured": F.when(name == "photo_captured", 1).otherwise(0),
        },
    )
    stats = stats.withColumn("total_revenue", F.coalesce("total_revenue", F.lit(0)))
    return stats.withColumn("user_status", _status(stats, clock.resolve(as_of)))


def _membership(events: DataFrame, tests: dict[str, Column], retained: bool = False) -> DataFrame:
    """Devices by what they did at any time: one scan and one shuffle for all tests.
    ``retained`` adds whether the last event is seven days or more after the first."""
    if not retained:
        events = events.filter(reduce(lambda a, b: a | b, tests.values()))
    span = [F.min("event_ts").alias("_first"), F.max("event_ts").alias("_last")]
    return device_flags(events, tests, *(span if retained else []))


def user_list(
    events: DataFrame,
    bounds: Bounds | None = None,
    filter: str = "all",
    search: str | None = None,
    country: str | None = None,
    tier: str | None = None,
    device: str | None = None,
    language: str | None = None,
    os: str | None = None,
    plan: str | None = None,
    sort: str = "last_active",
    order: str = "desc",
    limit: int = 50,
    offset: int = 0,
    as_of: datetime | None = None,
    after: tuple | None = None,
    deep: int = DEEP,
) -> Page:
    """Devices active in the window with status and purchases, filtered and paged.

    ``filter`` is ``all``, ``purchasers``, ``active``, ``churned`` or ``retained``.
    Membership tests look at all events, not only the window's. ``after``, the sort
    value and ``device_id`` of a page's last row, asks for the page that follows. An offset
    above ``deep`` runs a job that finds where the page begins.
    """
    if filter not in ("all", "purchasers", "active", "churned", "retained"):
        raise ValueError(f"unknown filter {filter!r}")
    now = clock.resolve(as_of)
    bounds = bounds or clock.trailing_range(now)
    inside = bounds.apply(events, "event_ts")
    tested = {"device_model": device, "locale": language, "os_version": os}
    sums = {"purchase_count": F.when(F.col("name") == "purchase_completed", 1).otherwise(0)}
    if search:
        # Any user id of the device may match, not only the one that is shown.
        text = search.lower()
        found = F.lower("device_id").contains(text) | F.lower("user_id").contains(text)
        sums["_found"] = F.when(found, 1).otherwise(0)
    users = device_totals(inside, [column for column, text in tested.items() if text], sums)

    name = F.col("name")
    bought = name == "purchase_completed"
    subscribed = name == "subscription_started"
    include: dict[str, Column] = {}
    exclude: dict[str, Column] = {}
    if filter == "purchasers":
        include["_bought"] = bought
    if country:
        include["_in_country"] = F.col("country") == country
    if tier and tier.lower() == "free":
        exclude["_paid"] = bought
    elif tier:
        include["_in_tier"] = subscribed & (prop("tier") == tier.lower())
    if plan:
        words = plan.lower().split(" ")
        period = "yearly" if words[1:2] == ["yearly"] else "monthly"
        include["_on_plan"] = (
            subscribed & (prop("tier") == words[0]) & (prop("billing_period") == period)
        )

    if filter == "active":
        lo = instant(users, "last_active", now - timedelta(days=7))
        users = users.filter(F.col("last_active") >= lo)
    elif filter == "churned":
        lo = instant(users, "last_active", now - timedelta(days=30))
        users = users.filter(F.col("last_active") < lo)
    if device:
        users = users.filter(F.lower("device_model").contains(device.lower()))
    if language:
        users = users.filter(F.lower("locale").startswith(language.lower()))
    if os:
        users = users.filter(F.lower("os_version").contains(os.lower()))
    if search:
        users = users.filter("_found > 0").drop("_found")

    retained = filter == "retained"
    if include or retained:
        members = _membership(events, include, retained)
        for flag in include:
            members = members.filter(F.col(flag))
        if retained:
            members = members.filter(F.expr("_last >= _first + INTERVAL '7' DAY"))
        users = users.join(members.select("device_id"), "device_id", "left_semi")
    if exclude:
        barred = _membership(events, exclude)
        users = users.join(barred.select("device_id"), "device_id", "left_anti")

    sorted_by = USER_SORTS.get(sort, "last_active")
    by = [order_by(sorted_by, order), F.col("device_id").asc()]
    following = users if after is None else users.filter(
        beyond(sorted_by, after[0], order, "device_id", after[1], "asc")
    )
    following, offset = from_offset(following, sorted_by, order, "device_id", "asc", offset, deep)
    rows = _page_of(
        inside, following, by, limit, offset, lambda chosen: users_with_purchases(chosen, ALL_TIME, now)
    )
    return Page(rows, users.agg(n_rows().alias("total")))


def _page_of(
    events: DataFrame, users: DataFrame, by: list[Column], limit: int, offset: int, detail
) -> DataFrame:
    """One page of ``users`` with all details.

    Order and filters need a few fixed-width figures only. The page is cut from those,
    and the details are worked out for the events of its devices alone.
    """
    if limit <= PAGE_BROADCAST_ROWS:
        page = paged(users, *by, limit=limit, offset=offset).select("device_id")
        chosen = events.join(F.broadcast(page), "device_id", "left_semi")
        return paged(detail(chosen), *by, limit=limit)
    kept = detail(events).join(users.select("device_id"), "device_id", "left_semi")
    return paged(kept, *by, limit=limit, offset=offset)


def subscribed_devices(subscriptions: DataFrame) -> DataFrame:
    """Ids, current or original, that ever bought or renewed."""
    paid = subscriptions.filter(F.col("event_type").isin("INITIAL_PURCHASE", "RENEWAL"))
    ids = paid.select(
        F.explode(F.array("app_user_id", "original_app_user_id")).alias("device_id")
    )
    return ids.filter(F.col("device_id").isNotNull()).distinct()


def user_detail(
    events: DataFrame,
    subscriptions: DataFrame,
    profiles: DataFrame,
    device_id: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """``user_stats`` over all time plus days since first and last activity, longest
    reported session, subscription status and profile; of every device, or of one."""
    if device_id is not None:
        events = of_device(events, device_id)
    now = clock.resolve(as_of)
    stats = device_rollup(events, max_duration=True)
    day = 86_400_000_000.0

    def days_since(column: str) -> Column:
        gap = F.timestamp_diff("MICROSECOND", F.col(column), instant(stats, column, now))
        return F.floor(gap / day)

    stats = stats.withColumns(
        {
            "days_since_install": days_since("first_seen"),
            "days_inactive": days_since("last_active"),
            "max_session_duration": F.coalesce("max_session_duration", F.lit(0)).cast("bigint"),
        }
    )
    paying = subscribed_devices(subscriptions).withColumn("_paying", F.lit(True))
    known = [c for c in profiles.columns if c != "device_id"]
    about = profiles.select("device_id", *[F.col(c).alias(f"profile_{c}") for c in known])
    status = (
        F.when(F.col("_paying"), F.lit("subscriber"))
        .when(F.col("days_inactive") <= 7, F.lit("active"))
        .when(F.col("days_inactive") > 30, F.lit("churned"))
        .otherwise(F.lit("inactive"))
    )
    return (
        stats.join(paying, "device_id", "left")
        .join(about, "device_id", "left")
        .withColumn("status", status)
        .drop("_paying")
    )


def event_breakdown(events: DataFrame, device_id: str | None = None) -> DataFrame:
    """Events by device and name over all time."""
    if device_id is not None:
        events = of_device(events, device_id)
    return events.groupBy("device_id", "name").agg(n_rows().alias("count"))


def latest_event_breakdown(
    events: DataFrame, device_id: str | None = None, k: int = 200
) -> DataFrame:
    """Events by name over the newest ``k`` events of each device."""
    if device_id is not None:
        events = of_device(events, device_id)
    newest = latest_per_key(
        events.select("device_id", "name", "event_ts", "id"),
        ["device_id"],
        [order_by("event_ts"), F.col("id").desc()],
        k,
        spread_by=["id"],
    )
    return newest.groupBy("device_id", "name").agg(n_rows().alias("count"))


def session_timeline(
    events: DataFrame, device_id: str | None = None, k: int = 20, newest_events: int | None = None
) -> DataFrame:
    """Newest ``k`` sessions of each device: start, end, events, length in ms, and the
    duration reported by the last event (of equal times, the greatest id). ``newest_events`` builds the sessions from
    that many newest events of a device only."""
    if device_id is not None:
        events = of_device(events, device_id)
    if newest_events is not None:
        events = latest_per_key(
            events, ["device_id"], [order_by("event_ts"), F.col("id").desc()], newest_events,
            spread_by=["id"],
        )
    sessions = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("device_id", "session_id")
        .agg(
            F.min("event_ts").alias("started"),
            F.max("event_ts").alias("ended"),
            n_rows().alias("events_count"),
            F.max_by("session_duration_seconds", F.struct("event_ts", "id")).alias("reported_duration"),
        )
    )
    sessions = sessions.withColumn(
        "duration_ms", F.timestamp_diff("MILLISECOND", F.col("started"), F.col("ended"))
    )
    return latest_per_key(
        sessions, ["device_id"], [order_by("started"), F.col("session_id").desc()], k,
        spread_by=["session_id"], rank="session_rank",
    )


def users_by_event(
    events: DataFrame, name: str, bounds: Bounds, limit: int = 100, offset: int = 0
) -> Page:
    """Devices that fired an event in the window, with their all-time activity and the
    properties of their last such event.

    The page is cut first, from fixed-width columns: its order needs the window only.
    Its devices, at most ``limit``, then pick their history and their properties.
    """
    fired = bounds.apply(events, "event_ts").filter(F.col("name") == name)
    per_device = fired.groupBy("device_id").agg(
        n_rows().alias("event_count"),
        F.min("event_ts").alias("first_occurrence"),
        F.max("event_ts").alias("last_occurrence"),
    )
    by = [order_by("last_occurrence"), F.col("device_id").asc()]
    page = paged(per_device, *by, limit=limit, offset=offset)
    chosen = F.broadcast(page) if limit <= PAGE_BROADCAST_ROWS else page
    stats = events.select("device_id", "event_ts").join(chosen, "device_id").groupBy(
        *page.columns
    ).agg(
        F.min("event_ts").alias("first_seen"),
        F.max("event_ts").alias("last_active"),
        n_rows().alias("total_events"),
    )
    last = fired.select("device_id", "event_ts", "id", "properties").join(
        chosen, "device_id"
    ).groupBy("device_id").agg(
        F.max_by("properties", F.struct("event_ts", "id")).alias("last_properties")
    )
    total = fired.agg(F.countDistinct("device_id").alias("total"))
    return Page(paged(stats.join(last, "device_id"), *by, limit=limit), total)


def funnel_dropoff(
    events: DataFrame, completed: str, not_completed: str, bounds: Bounds, limit: int | None = 100
) -> DataFrame:
    """Devices that did the first event in the window and not the second, with their
    all-time activity, latest first. One pass: both tests are flags of the device."""
    inside = bounds.holds(events, "event_ts")
    name = F.col("name")
    per_device = device_flags(
        events,
        {"_did": inside & (name == completed), "_did_next": inside & (name == not_completed)},
        F.min("event_ts").alias("first_seen"),
        F.max("event_ts").alias("last_active"),
        n_rows().alias("total_events"),
    )
    lost = per_device.filter(F.col("_did") & ~F.col("_did_next")).drop("_did", "_did_next")
    order = [order_by("last_active"), F.col("device_id").asc()]
    return lost.orderBy(*order) if limit is None else paged(lost, *order, limit=limit)


def dropped_devices(
    events: DataFrame, from_step: str, to_step: str, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    """Ids of devices at one funnel step that never reached the other."""
    found = clock.since(as_of, days).apply(events, "event_ts")
    source, target = _step(from_step), _step(to_step)
    per_device = device_flags(found.filter(source | target), {"_did": source, "_did_next": target})
    return per_device.filter(F.col("_did") & ~F.col("_did_next")).select("device_id")


def _step(step: str) -> Column:
    test = F.col("name") == STEP_EVENTS.get(step, step)
    return test & (prop("granted") == "true") if step == "permission_granted" else test


def users_at_step(
    events: DataFrame, step: str, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    """Distinct devices at a named funnel step, or that fired an event of that name."""
    found = clock.since(as_of, days).apply(events, "event_ts").filter(_step(step))
    return found.select("device_id").distinct()


def segment_users(
    events: DataFrame,
    segment: str = "all",
    event_name: str | None = None,
    date_from=None,
    date_to=None,
    sort: str = "last_seen",
    order: str = "desc",
    limit: int = 100,
    offset: int = 0,
    as_of: datetime | None = None,
    after: tuple | None = None,
) -> Page:
    """Devices of a segment: ``dau``, ``wau``, ``mau``, ``new_today``, ``returning`` or
    ``all``. Event and date filters apply before first and last activity are taken.

    ``after``, the sort value and ``device_id`` of a page's last row, asks for the page
    that follows.
    """
    today = clock.midnight(clock.resolve(as_of))
    reach = {"dau": 0, "wau": 7, "mau": 30}
    if segment not in (*reach, "new_today", "returning", "all"):
        raise ValueError(f"unknown segment {segment!r}")
    if segment in reach:
        bounds = Bounds(lo=today - timedelta(days=reach[segment]))
    elif date_from and date_to:
        end = datetime.combine(clock.as_date(date_to), clock.END_OF_DAY)
        bounds = Bounds(clock.midnight(date_from), end)
    elif date_from:
        bounds = Bounds(lo=clock.midnight(date_from))
    else:
        bounds = ALL_TIME
    found = bounds.apply(events, "event_ts")
    if event_name:
        found = found.filter(F.col("name") == event_name)
    users = device_totals(found, [])
    day = F.lit(today.date())
    if segment == "new_today":
        users = users.filter(F.to_date("first_seen") == day)
    elif segment == "returning":
        users = users.filter((F.to_date("first_seen") < day) & (F.to_date("last_active") == day))
    sorted_by = SEGMENT_SORTS.get(sort, "last_active")
    by = [order_by(sorted_by, order), F.col("device_id").asc()]
    following = users if after is None else users.filter(
        beyond(sorted_by, after[0], order, "device_id", after[1], "asc")
    )
    rows = _page_of(found, following, by, limit, offset, device_rollup).select(
        "device_id",
        "first_seen",
        F.col("last_active").alias("last_seen"),
        F.col("total_events").alias("events_count"),
        F.col("total_sessions").alias("sessions_count"),
        "platform", "os_version", "device_model", "app_version", "locale", "timezone",
    )
    return Page(rows, users.agg(n_rows().alias("total")))


def cohort_members(events: DataFrame, day, return_day: int | None = None) -> DataFrame:
    """Devices first seen on ``day``; with ``return_day``, whether each was active that
    many days later. Both facts come from one aggregation."""
    start = clock.as_date(day)
    measures = []
    if return_day is not None:
        back = clock.one_day(start + timedelta(days=int(return_day))).holds(events, "event_ts")
        measures.append(F.max(back).alias("returned"))
    per_device = events.groupBy("device_id").agg(F.min("event_ts").alias("first_seen"), *measures)
    members = clock.one_day(start).apply(per_device, "first_seen")
    return members if return_day is None else members.drop("first_seen")
