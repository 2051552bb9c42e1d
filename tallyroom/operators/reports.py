"""Summaries of landed third-party report payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyroom.clock import Bounds
from tallyroom.functions import duration_text, js_round, ratio
from tallyroom.functions.counts import n_rows
from tallyroom.plans import latest_per_key, paged, top_k

# Shares of users per session bucket, and of sessions per length.
ENGAGEMENT_SHARES = [
    ("1 session", 0.4), ("2-5 sessions", 0.35), ("6-10 sessions", 0.15), ("10+ sessions", 0.1),
]
SECONDS_PER_PHOTO, BASE_SECONDS = 5, 30


def _whole(value: Column) -> Column:
    return F.floor(value + 0.5)


# Series: ``xValues`` labels and ``series[0]`` values.


def series_to_rows(reports: DataFrame, *keep: str, value: str = "count") -> DataFrame:
    """One row per label with its value, 0 where the series has none."""
    at = reports.select(
        *keep, F.get("series", F.lit(0)).alias("_values"), F.posexplode("xValues").alias("_i", "date")
    ).filter(F.col("_values").isNotNull())
    return at.select(*keep, "date", F.coalesce(F.get("_values", F.col("_i")), F.lit(0.0)).alias(value))


def series_summary(reports: DataFrame, *keep: str) -> DataFrame:
    """Latest value, sum, and rounded mean of the days above zero."""
    values = F.coalesce(
        F.when(F.col("xValues").isNotNull(), F.get("series", F.lit(0))),
        F.array().cast("array<double>"),
    )
    above = F.filter(values, lambda v: v > 0)

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))

    mean = F.when(F.size(above) > 0, _whole(total(above) / F.size(above))).otherwise(F.lit(0))
    return reports.select(
        *keep,
        F.coalesce(F.get(values, F.size(values) - 1), F.lit(0.0)).alias("latest"),
        total(values).alias("total"),
        mean.cast("double").alias("average"),
    )


def session_length_summary(reports: DataFrame, *keep: str) -> DataFrame:
    """The source's own collapsed average, as seconds and as text."""
    collapsed = F.get(F.get("seriesCollapsed", F.lit(0)), F.lit(0)).getField("value")
    average = F.coalesce(collapsed, F.lit(0.0))
    return reports.select(
        *keep, average.alias("average"), duration_text(average).alias("average_formatted")
    )


# Event totals: ``data`` is a list of ``{name, totals}``.


def event_totals(reports: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """Sum of all totals and the totals of named events, the first of a name, else 0."""
    data = F.coalesce("data", F.array().cast(reports.schema["data"].dataType))
    cells = []
    for name in names:
        first = F.get(F.filter(data, lambda e: e["name"] == name), F.lit(0))["totals"]
        cells.append(F.coalesce(first, F.lit(0)).cast("bigint").alias(name))
    total = F.aggregate(
        data, F.lit(0).cast("bigint"),
        lambda acc, e: acc + F.coalesce(e["totals"], F.lit(0)).cast("bigint"),
    )
    return reports.select(*keep, total.alias("total_events"), *cells)


def top_events(
    reports: DataFrame, *keep: str, k: int = 10, ranked: bool = False
) -> DataFrame:
    """First ``k`` entries of each report in source order, or, ``ranked``, its ``k``
    greatest positive totals."""
    data = F.col("data")
    if ranked:
        # Greatest total first; equal totals keep their source order.
        keyed = F.transform(
            F.filter(data, lambda e: e["totals"] > 0),
            lambda e, i: F.struct((-e["totals"]).alias("neg"), i.alias("i"), e["name"].alias("name")),
        )
        listed = F.transform(
            F.sort_array(keyed),
            lambda e: F.struct(e["name"].alias("name"), (-e["neg"]).alias("totals")),
        )
    else:
        listed = data
    rows = reports.select(*keep, F.posexplode(F.slice(listed, 1, k)).alias("_i", "_e"))
    return rows.select(
        *keep,
        (F.col("_i") + 1).alias("position"),
        F.col("_e.name").alias("name"),
        F.coalesce("_e.totals", F.lit(0)).cast("bigint").alias("count"),
    )


# Estimates from totals. The exact figures are in ``operators.events``.


def engagement_estimates(totals: DataFrame, *keep: str) -> DataFrame:
    """Per-user rates and a session length guessed from photos, from ``sessions``,
    ``photos`` and ``active_users``; no users count as one."""
    sessions, photos = F.col("sessions"), F.col("photos")
    users = F.when(F.col("active_users") > 0, F.col("active_users")).otherwise(F.lit(1))
    per_session = ratio(photos, sessions)
    return totals.select(
        *keep,
        sessions,
        users.alias("active_users"),
        (F.floor(ratio(sessions, users) * 10 + 0.5) / 10.0).alias("sessions_per_user"),
        (F.floor(ratio(photos, users) * 10 + 0.5) / 10.0).alias("photos_per_user"),
        _whole(per_session * SECONDS_PER_PHOTO + BASE_SECONDS).alias("avg_session_duration_seconds"),
    )


def estimated_buckets(estimates: DataFrame, *keep: str) -> DataFrame:
    """Users by sessions and sessions by length, from fixed shares; none without sessions."""
    seconds = F.col("avg_session_duration_seconds")
    lengths = [
        ("< 30s", F.when(seconds < 60, 0.35).otherwise(0.2)),
        ("30s-1m", F.when(seconds < 120, 0.3).otherwise(0.25)),
        ("1-5m", F.lit(0.3)), ("5-15m", F.lit(0.12)), ("15m+", F.lit(0.03)),
    ]
    parts = [("engagement", label, F.col("active_users") * F.lit(share))
             for label, share in ENGAGEMENT_SHARES]
    parts += [("duration", label, F.col("sessions") * share) for label, share in lengths]
    cells = [
        F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("bucket"), _whole(n).alias("count"))
        for kind, label, n in parts
    ]
    return estimates.filter(F.col("sessions") > 0).select(*keep, F.inline(F.array(*cells)))


def retention_curve_points(reports: DataFrame, *keep: str) -> DataFrame:
    """Days 1, 7 and 30 of a retention curve in whole percent, 0 if missing."""

    def point(day: int) -> Column:
        share = F.get("combinedRetention", F.lit(day))
        return F.coalesce(_whole(share * 100), F.lit(0)).alias(f"d{day}")

    return reports.select(*keep, point(1), point(7), point(30))


# Issues.


def issue_stat_rows(stats: DataFrame) -> DataFrame:
    """``[epoch seconds, count]`` pairs to rows."""
    pairs = stats.select(F.explode("stats").alias("_p"))
    return pairs.select(F.col("_p")[0].alias("epoch_s"), F.col("_p")[1].alias("count"))


def issue_summary(issues: DataFrame, stats: DataFrame) -> DataFrame:
    """Events in all, unresolved issues, and those of level fatal or error. ``stats``
    has one row per period with its ``count``."""
    # Both one-row sums travel in one aggregate over the stacked inputs.
    listed = issues.select(
        F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("issue"),
        F.col("level").isin("fatal", "error").cast("int").alias("critical"),
    )
    counted = stats.select(
        F.col("count").cast("bigint").alias("n"), F.lit(0).alias("issue"), F.lit(0).alias("critical")
    )
    return listed.unionByName(counted).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("issue"), F.lit(0)).alias("unresolved_issues"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical_issues"),
    )


def issue_list(issues: DataFrame) -> DataFrame:
    """Issue fields under their own names."""
    renamed = {"userCount": "user_count", "firstSeen": "first_seen", "lastSeen": "last_seen",
               "shortId": "short_id"}
    return issues.select(*[F.col(c).alias(renamed.get(c, c)) for c in issues.columns])


def issue_events_by_day(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_date(F.timestamp_seconds("epoch_s")).alias("date"), "count")


def issue_recent_events(issues: DataFrame, events: DataFrame, k: int = 10) -> DataFrame:
    """Issue details next to each issue's newest ``k`` events."""
    newest = latest_per_key(
        events, ["issue_id"], [F.col("event_ts").desc(), F.col("id").desc()], k,
        spread_by=["id"], rank="event_rank",
    )
    return issues.join(newest, "issue_id")


# Reviews and versions.


def review_summary(reviews: DataFrame) -> DataFrame:
    """Number, mean rating and ratings 1 to 5; a missing rating counts as a review
    and adds nothing to the sum."""
    rating = F.coalesce("rating", F.lit(0))
    return reviews.agg(
        n_rows().alias("total_reviews"),
        (F.floor(ratio(F.sum(rating), n_rows()) * 10 + 0.5) / 10.0).alias("average_rating"),
        *[F.count_if(F.col("rating") == n).alias(f"rating_{n}") for n in range(1, 6)],
    )


# What is shown of a review.
REVIEW_COLUMNS = ["id", "rating", "title", "body", "reviewerNickname", "createdDate", "territory"]


def review_rows(reviews: DataFrame, k: int | None = None) -> DataFrame:
    """The ``k`` newest reviews, or all; what a source leaves out is null."""
    known = [F.col(c) if c in reviews.columns else F.lit(None).cast("string").alias(c) for c in REVIEW_COLUMNS]
    return top_k(reviews.select(*known), F.col("createdDate").desc_nulls_first(), F.col("id").desc(), k=k)


def version_history(versions: DataFrame, k: int = 10) -> DataFrame:
    newest = paged(versions, F.col("createdDate").desc_nulls_first(), F.col("id").desc(), limit=k)
    return newest.select("id", "versionString", "appStoreState", "releaseType", "createdDate")


# Search performance.


def search_totals(rows: DataFrame) -> DataFrame:
    """Clicks, impressions, the rate from their totals and the plain mean position."""
    clicks, impressions = F.coalesce("clicks", F.lit(0)), F.coalesce("impressions", F.lit(0))
    sums = rows.agg(
        F.coalesce(F.sum(clicks), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum(impressions), F.lit(0)).alias("impressions"),
        ratio(F.sum(F.coalesce("position", F.lit(0.0))), n_rows()).alias("_position"),
    )
    rate = ratio(F.col("clicks"), F.col("impressions")) * 100
    return sums.select(
        "clicks",
        "impressions",
        js_round(rate, 2).alias("ctr"),
        js_round(F.col("_position"), 1).alias("avg_position"),
    )


def search_by_dimension(
    rows: DataFrame, dimension: str, limit: int | None = None, bounds: Bounds | None = None
) -> DataFrame:
    """Rows of one dimension with the rate in percent, most clicked first. ``keys[0]``
    is the value; rows may instead carry a ``key`` column."""
    if bounds is not None:
        rows = bounds.apply(rows, "date")
    key = F.get("keys", F.lit(0)) if "keys" in rows.columns else F.col("key")
    keyed = rows.select(
        key.alias(dimension),
        "clicks",
        "impressions",
        (F.floor(F.coalesce("ctr", F.lit(0.0)) * 10000 + 0.5) / 100.0).alias("ctr"),
        js_round(F.coalesce("position", F.lit(0.0)), 1).alias("position"),
    )
    return top_k(keyed, F.desc("clicks"), F.desc("impressions"), F.asc(dimension), k=limit)
