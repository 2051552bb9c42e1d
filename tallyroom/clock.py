"""Explicit points in time and the event-time windows built from them.

All moments are UTC. Bounds are resolved to literals of the filtered column's
own type, so the comparison reaches the parquet scan without a cast.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

END_OF_DAY = time(23, 59, 59, 999000)

# The event time column, and the day column event tables are partitioned by.
PARTITIONED_TIME = "event_ts"
PARTITION = "event_date"


def resolve(as_of: datetime | None) -> datetime:
    """The given moment as naive UTC; the current time when none is given."""
    if as_of is None:
        as_of = datetime.now(timezone.utc)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of


def as_date(value: date | datetime | str) -> date:
    if isinstance(value, str):
        return date.fromisoformat(value[:10])
    return value.date() if isinstance(value, datetime) else value


def midnight(value: date | datetime | str) -> datetime:
    return datetime.combine(as_date(value), time())


def instant(df: DataFrame, column: str, moment: datetime) -> Column:
    """``moment`` as a literal of the type of ``column``."""
    text = resolve(moment).isoformat(sep=" ", timespec="microseconds")
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.DateType):
        return F.expr(f"DATE '{text[:10]}'")
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{text}'")
    return F.expr(f"TIMESTAMP_LTZ '{text}+00:00'")


@dataclass(frozen=True)
class Bounds:
    """A window over a time column; a missing bound is unbounded."""

    lo: datetime | None = None
    hi: datetime | None = None
    lo_open: bool = False
    hi_open: bool = False

    def holds(self, df: DataFrame, column: str) -> Column:
        tests = []
        if self.lo is not None:
            lo = instant(df, column, self.lo)
            tests.append(F.col(column) > lo if self.lo_open else F.col(column) >= lo)
        if self.hi is not None:
            hi = instant(df, column, self.hi)
            tests.append(F.col(column) < hi if self.hi_open else F.col(column) <= hi)
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        """Rows inside the window. Stored events are partitioned by ``event_date``,
        so bounds on ``event_ts`` name the days as well and other days are not read."""
        if self.lo is None and self.hi is None:
            return df
        inside = df.filter(self.holds(df, column))
        if column == PARTITIONED_TIME and PARTITION in df.columns:
            first = None if self.lo is None else midnight(self.lo)
            last = None if self.hi is None else midnight(self.hi)
            inside = inside.filter(Bounds(first, last).holds(df, PARTITION))
        return inside

    @property
    def days(self) -> int:
        """Calendar days touched by a window closed on both sides."""
        if self.lo is None or self.hi is None:
            raise ValueError("an open-ended window has no day count")
        return (self.hi.date() - self.lo.date()).days + 1


ALL_TIME = Bounds()


def _whole(name: str, value: int) -> int:
    value = int(value)
    if value < 0:
        raise ValueError(f"{name} must not be negative")
    return value


def date_range(as_of=None, days: int = 30, start=None, end=None) -> Bounds:
    """Whole days ``start``..``end`` when both are given, else the last ``days``
    from midnight up to ``as_of``; both ends belong to the window."""
    if start is not None and end is not None:
        return Bounds(midnight(start), datetime.combine(as_date(end), END_OF_DAY))
    now = resolve(as_of)
    return Bounds(midnight(now - timedelta(days=_whole("days", days))), now)


def trailing_range(as_of=None, days: int = 90, start=None, end=None) -> Bounds:
    """As ``date_range``, but the last ``days`` start at the time of day of ``as_of``."""
    if start is not None and end is not None:
        return date_range(as_of, days, start, end)
    now = resolve(as_of)
    return Bounds(now - timedelta(days=_whole("days", days)), now)


def since_midnight(as_of=None, days: int = 30) -> Bounds:
    """From midnight ``days`` ago, no upper bound."""
    return Bounds(lo=midnight(resolve(as_of) - timedelta(days=_whole("days", days))))


def since(as_of=None, days: int = 30) -> Bounds:
    """From the same time of day ``days`` ago, no upper bound."""
    return Bounds(lo=resolve(as_of) - timedelta(days=_whole("days", days)))


def sync_window(as_of=None, days: int = 7) -> Bounds:
    """Hours 00 of the first day to 23 of the last day, all of them included."""
    now = resolve(as_of)
    first = midnight(now - timedelta(days=_whole("days", days)))
    return Bounds(first, midnight(now) + timedelta(days=1), hi_open=True)


def lagged_window(as_of=None, days: int = 28, lag: int = 2) -> Bounds:
    """Days ``days + lag`` ago to ``lag`` ago, for sources that publish late."""
    today = midnight(resolve(as_of))
    last = today - timedelta(days=_whole("lag", lag))
    first = last - timedelta(days=_whole("days", days))
    return Bounds(first, datetime.combine(last.date(), END_OF_DAY))


def one_day(day) -> Bounds:
    return Bounds(midnight(day), midnight(day) + timedelta(days=1), hi_open=True)
