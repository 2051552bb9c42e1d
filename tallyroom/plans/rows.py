"""One-row aggregates: put several side by side, or turn their columns to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def join_single_rows(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row, without a cross join.

    The frames are stacked and each column keeps its only non-null value.
    """
    columns = [c for f in frames for c in f.columns]
    if len(columns) != len(set(columns)):
        raise ValueError("one-row frames share column names")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


def single_row_to_rows(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """One output row per entry, its cells computed from the columns of ``df``."""
    cells = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return df.select(F.inline(F.array(*cells)))
