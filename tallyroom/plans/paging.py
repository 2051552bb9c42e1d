"""Newest-first pages with their totals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, functions as F

from tallyroom.session import scratch_path

#: Rows before a page that a task may have to keep; beyond, the page's place is looked up.
DEEP = 10_000
_PLACE_BITS = 33


class Page(NamedTuple):
    """``rows`` is one page, ``total`` one row about everything the page is cut from."""

    rows: DataFrame
    total: DataFrame


def order_by(column: str, order: str = "desc") -> Column:
    """Descending order has nulls first, ascending order has them last."""
    if order not in ("asc", "desc"):
        raise ValueError("order is 'asc' or 'desc'")
    return F.col(column).asc_nulls_last() if order == "asc" else F.col(column).desc_nulls_first()


def beyond(column: str, value, order: str, tie: str, tie_value, tie_order: str) -> Column:
    """Rows that follow the row with ``value`` and ``tie_value`` in ``order_by(column, order)``
    and then ``tie``, which has no nulls: what the next page is cut from, whatever its
    depth."""
    here, at = F.col(column), F.lit(value)
    past_tie = F.col(tie) < F.lit(tie_value) if tie_order == "desc" else F.col(tie) > F.lit(tie_value)
    if order == "desc":
        if value is None:
            return here.isNotNull() | past_tie
        return (here < at) | ((here == at) & past_tie)
    if value is None:
        return here.isNull() & past_tie
    return here.isNull() | (here > at) | ((here == at) & past_tie)


def paged(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit``; each scan task keeps no more than that
    many, so deep offsets cost memory and the key filter ``beyond`` is the better way there."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def row_at(df: DataFrame, columns: list[str], order: list[Column], position: int) -> Row | None:
    """The ``columns`` of the row at ``position`` (from 0) in ``order``, None if there are
    fewer. Rows, reduced to ``columns``, are sorted in ranges and stored; the driver adds up
    one count a range, and the range that holds the position is looked into."""
    path = scratch_path(df.sparkSession, "places")
    ordered = df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy(F.shiftright("_at", _PLACE_BITS).alias("part")).count().collect()
    for part, count in sorted(counts):
        if position < count:
            return rows.filter(F.col("_at") == (part << _PLACE_BITS) + position).select(*columns).first()
        position -= count
    return None


def from_offset(
    df: DataFrame, column: str, order: str, tie: str, tie_order: str, offset: int, deep: int = DEEP
) -> tuple[DataFrame, int]:
    """``df`` and the offset to page it from, in ``order_by(column, order)`` and then ``tie``.
    For an offset above ``deep`` the row before the page is looked up, and what follows it is
    left with no offset, so that no task keeps the rows of all pages before."""
    if offset <= deep:
        return df, offset
    by = [order_by(column, order), order_by(tie, tie_order)]
    last = row_at(df, [column, tie], by, offset - 1)
    if last is None:
        return df.limit(0), 0
    return df.filter(beyond(column, last[0], order, tie, last[1], tie_order)), 0


def top_k(df: DataFrame, *order: Column, k: int | None) -> DataFrame:
    return df.orderBy(*order) if k is None else paged(df, *order, limit=k)
