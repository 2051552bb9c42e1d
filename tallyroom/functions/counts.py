"""The two counts every report is made of."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_distinct(column: str) -> Column:
    return F.countDistinct(column)
