"""Access to the JSON property bag of an event."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two boolean spellings Spark's own cast does not know.
EXTRA_BOOLEANS = {"on": True, "off": False}


def prop(key: str, column: str = "properties") -> Column:
    """A property as text; null when it is missing or JSON null."""
    if not key or "'" in key or "]" in key:
        raise ValueError(f"unsupported property key {key!r}")
    return F.get_json_object(F.col(column), f"$['{key}']")


def as_bool(text: Column) -> Column:
    """Text to boolean, null when it is none."""
    word = F.lower(F.trim(text))
    out = text.try_cast("boolean")
    for spelling, value in EXTRA_BOOLEANS.items():
        out = F.when(word == spelling, F.lit(value)).otherwise(out)
    return out


def as_int(text: Column) -> Column:
    return text.try_cast("int")


def as_double(text: Column) -> Column:
    return text.try_cast("double")


def as_money(text: Column) -> Column:
    return text.try_cast("decimal(18,2)")
