"""Size check in front of every broadcast of caller-supplied data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading little more than those."""
    return df.limit(max_rows + 1).count() <= max_rows
