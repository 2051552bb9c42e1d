"""Numbering and joining that stand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyroom.llm.tables import stored

#: A key with more than 1 / HOT of all rows is hot, so at most HOT keys are.
HOT = 2048
#: Bits of a row's place within its partition in Spark's increasing ids.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str, cuts: list[Column] | None = None) -> DataFrame:
    """``df`` with the place of each row, from 1, in ``order`` as column ``name``.

    Rows are sorted in ranges, each task numbers its own, and the driver adds up one count
    a range. ``df`` should be a table: its row ids break ties, so that equal rows, which
    stand in any order, need not lie in one range. ``cuts`` are the columns to cut ranges at
    instead, where those of ``order`` are too wide to be sampled; rows apart in them must
    stand in the same order by both.
    """
    spark, free = df.sparkSession, free_names(df, "tie", "at")
    cuts = cuts or [*order, F.col(free["tie"])]
    sorted_ = (
        df.withColumn(free["tie"], F.monotonically_increasing_id())
        .repartitionByRange(*cuts)
        .sortWithinPartitions(*order)
        .drop(free["tie"])
        .withColumn(free["at"], F.monotonically_increasing_id())
    )
    table = stored(sorted_, "numbered")
    part, at = F.shiftright(free["at"], _PLACE_BITS), F.col(free["at"]).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    counts = sorted(table.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for number, count in counts:
        starts.append((number, before))
        before += count
    known = spark.createDataFrame(starts, f"{free['tie']} long, {name} long")
    return (
        table.join(F.broadcast(known), part == F.col(free["tie"]))
        .withColumn(name, F.col(name) + at + 1)
        .select(*[F.col(f"`{c}`") for c in df.columns], name)
    )


def matched(rows: DataFrame, groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row a key and in ``count`` how
    many of ``rows`` it has. Both should be tables, as they are read more than once.

    The groups that are hot are at most HOT and are sent to all tasks; the others meet
    their rows in a shuffle, where none has more than 1 / HOT of them.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = groups.where(F.col(count) * HOT > total)
    others = groups.where(F.col(count) * HOT <= total)
    there = rows.join(F.broadcast(hot), keys)
    elsewhere = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(others, keys)
    return there.unionByName(elsewhere)


def free_names(df: DataFrame, *wanted: str) -> dict[str, str]:
    """A column name for each wanted one that ``df`` does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in wanted:
        free = f"__{name}"
        while free in taken:
            free += "_"
        out[name] = free
        taken.add(free)
    return out
