"""Rounding and guarded ratios, evaluated inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def js_round(value: Column, digits: int = 0) -> Column:
    """Nearest multiple of 10^-digits, ties towards positive infinity."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5) / F.lit(scale)


def to_fixed(value: Column, digits: int) -> Column:
    """Nearest multiple of 10^-digits, ties away from zero, never ``-0.0``."""
    scale = float(10**digits)
    size = F.floor(F.abs(value.cast("double")) * scale + 0.5) / F.lit(scale)
    return F.when(value < 0, F.lit(0.0) - size).otherwise(size)


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``part / whole`` as a double; ``empty`` when ``whole`` is zero or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def percent(part: Column, whole: Column, digits: int, empty: float = 0.0) -> Column:
    """``part`` in percent of ``whole``; ``empty`` unless ``whole`` is positive."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.when(whole > 0, to_fixed(share, digits)).otherwise(F.lit(empty))


def conversion_rate(purchases: Column, views: Column) -> Column:
    """Whole percent of views that became purchases, 0 without views."""
    share = F.try_divide(purchases.cast("double"), views.cast("double")) * 100
    return F.when(views > 0, F.floor(share + 0.5)).otherwise(F.lit(0)).cast("bigint")


def hybrid_metric(primary: Column, fallback: Column) -> Column:
    """The primary value; the fallback when it is zero or missing."""
    return F.coalesce(F.nullif(primary, F.lit(0)), fallback)


def duration_text(seconds: Column) -> Column:
    """``Mm Ss``, or ``0s`` for nothing."""
    minutes = F.floor(seconds / 60)
    rest = F.floor(F.pmod(seconds, F.lit(60.0)) + 0.5)
    return F.when(seconds > 0, F.format_string("%dm %ds", minutes, rest)).otherwise(F.lit("0s"))
