"""JSON text lines with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def parse_json_lines(lines: DataFrame, payload: T.StructType, *keep: str) -> DataFrame:
    """The fields of every non-blank line in ``value``, next to the ``keep`` columns;
    an unreadable line has its text in ``_corrupt_record``.

    The parsed struct passes through ``inline``, so a line is parsed once however many
    of its fields later filters and projections use.
    """
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json("value", payload, options)
    return lines.filter(F.trim("value") != "").select(*keep, F.inline(F.array(parsed)))
