"""The newest k rows of every key, also where one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    spread_by: list[str],
    salts: int = 16,
    rank: str | None = None,
) -> DataFrame:
    """Top ``k`` rows per key in ``order``; ``rank`` names the kept row number.

    A key is first cut to ``k`` rows within each of ``salts`` slices chosen by the
    hash of ``spread_by``, so no task sorts more than a slice of a hot key, and the
    final sort sees at most ``k * salts`` rows of it. The result is exact.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    cut = df
    if salts > 1:
        slice_no = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
        within = Window.partitionBy(*keys, "_slice").orderBy(*order)
        cut = (
            df.withColumn("_slice", slice_no)
            .withColumn("_rank", F.row_number().over(within))
            .filter(F.col("_rank") <= k)
            .drop("_slice", "_rank")
        )
    name = rank or "_rank"
    final = Window.partitionBy(*keys).orderBy(*order)
    out = cut.withColumn(name, F.row_number().over(final)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)
