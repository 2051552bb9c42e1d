"""Cohort retention. Each operator keeps its own notion of the first day: within
the window for daily and overall retention, over all time for weekly cohorts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tallyroom import clock
from tallyroom.clock import Bounds
from tallyroom.functions import percent
from tallyroom.plans import active_on, activity_words, device_flags, first_index, paged, single_row_to_rows

# The days and weeks retention is reported for.
RETENTION_DAYS = (1, 7, 30)
WEEKLY_PERIODS = (1, 7, 14, 30)


def daily_cohort_retention(events: DataFrame, bounds: Bounds, k: int = 14) -> DataFrame:
    """Devices by first day in the window, and how many were active exactly 1, 7 and
    30 days later; the newest ``k`` cohorts."""
    first = first_index(bounds)
    devices = activity_words(events, bounds).select(
        F.to_date("first_seen").alias("cohort_date"),
        *[active_on(bounds, first + n).alias(f"_d{n}") for n in RETENTION_DAYS],
    )
    cohorts = devices.groupBy("cohort_date").agg(
        F.count(F.lit(1)).alias("cohort_size"),
        *[F.count_if(F.col(f"_d{n}")).alias(f"d{n}_retained") for n in RETENTION_DAYS],
    )
    newest = paged(cohorts, F.col("cohort_date").desc(), limit=k)
    size = F.col("cohort_size")
    return newest.withColumns(
        {f"d{n}_rate": percent(F.col(f"d{n}_retained"), size, 1) for n in RETENTION_DAYS}
    )


def overall_retention(events: DataFrame, bounds: Bounds) -> DataFrame:
    """Share of devices last active at least 1, 7 and 30 days after their first day in
    the window; zeros without any device."""
    spans = bounds.apply(events, "event_ts").groupBy("device_id").agg(
        F.datediff(F.max(F.to_date("event_ts")), F.min(F.to_date("event_ts"))).alias("_span")
    )
    sums = spans.agg(
        F.count(F.lit(1)).alias("total_users"),
        *[F.count_if(F.col("_span") >= n).alias(f"d{n}_retained") for n in RETENTION_DAYS],
    )
    total = F.col("total_users")
    return sums.withColumns(
        {f"d{n}_retention": percent(F.col(f"d{n}_retained"), total, 1) for n in RETENTION_DAYS}
    )


def weekly_cohort_retention(
    events: DataFrame,
    as_of: datetime | None = None,
    weeks: int = 4,
    periods: tuple[int, ...] = WEEKLY_PERIODS,
) -> DataFrame:
    """Devices by the week of their first event ever, oldest week first. For each
    period the percentage active on that day, counted from the end of the week; null
    where the day is not over yet or nobody joined.

    All days asked for are known in advance, so one pass reduces each device to its
    first event and one flag per day.
    """
    ends, over = weeks_and_days(as_of, weeks, periods)
    flags = {f"_on_{d:%Y%m%d}": clock.one_day(d).holds(events, "event_ts") for d in over}
    devices = device_flags(events, flags, F.min("event_ts").alias("first_seen"))
    return cohort_rows(devices, ends, over, periods)


def weeks_and_days(
    as_of: datetime | None, weeks: int, periods: tuple[int, ...]
) -> tuple[list[datetime], list[datetime]]:
    """The ends of the weeks, newest first, and the days asked for that are over, in order."""
    now = clock.resolve(as_of)
    today = clock.midnight(now)
    ends = [today - timedelta(days=7 * i) for i in range(weeks)]
    days = sorted({end + timedelta(days=p - 1) for end in ends for p in periods})
    return ends, [d for d in days if d + timedelta(days=1) <= now]


def cohort_rows(
    devices: DataFrame, ends: list[datetime], over: list[datetime], periods: tuple[int, ...]
) -> DataFrame:
    """A row a week, oldest first, of ``devices`` with first_seen and a flag for each day that
    is over."""
    sums, rows = [], []
    for i in reversed(range(len(ends))):
        start, end = ends[i] - timedelta(days=7), ends[i]
        joined = Bounds(start, end, hi_open=True).holds(devices, "first_seen")
        sums.append(F.count_if(joined).alias(f"_size_{i}"))
        size = F.col(f"_size_{i}")
        row = {"week": F.lit(i + 1), "cohort_start": F.lit(start.date()), "cohort_size": size}
        for p in periods:
            day = end + timedelta(days=p - 1)
            if day in over:
                name = f"_kept_{i}_{p}"
                sums.append(F.count_if(joined & F.col(f"_on_{day:%Y%m%d}")).alias(name))
                share = F.try_divide(F.col(name).cast("double"), size.cast("double")) * 100
                row[f"day{p}"] = share
            else:
                row[f"day{p}"] = F.lit(None).cast("double")
        rows.append(row)
    return single_row_to_rows(devices.agg(*sums), rows)
