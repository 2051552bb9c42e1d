"""Unordered conversion funnels: distinct devices per step."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyroom import clock
from tallyroom.clock import Bounds
from tallyroom.functions import percent, prop
from tallyroom.plans import device_flags, single_row_to_rows

# The steps of the purchase funnel.
PURCHASE_STEPS = [
    "app_opened", "camera_opened", "photo_captured", "paywall_viewed", "purchase_started",
    "purchase_completed",
]


class Stage(NamedTuple):
    """A labelled event, optionally with a property that must have a value."""

    label: str
    event: str
    key: str | None = None
    value: str | None = None

    def test(self) -> Column:
        named = F.col("name") == self.event
        return named if self.key is None else named & (prop(self.key) == self.value)


# The stages of the subscription funnel.
SUBSCRIPTION_STAGES = [
    Stage("App Opened", "app_opened"),
    Stage("Permission Granted", "permission_result", "granted", "true"),
    Stage("First Photo", "photo_captured"),
    Stage("First Scan", "scan_started"),
    Stage("Paywall Viewed", "paywall_viewed"),
    Stage("Subscription Started", "subscription_started"),
]


def _step_counts(events: DataFrame, stages: list[Stage]) -> DataFrame:
    """One row with the devices of each stage, from one scan and one shuffle."""
    found = events.filter(F.col("name").isin(sorted({s.event for s in stages})))
    flags = {f"_did_{i}": stage.test() for i, stage in enumerate(stages)}
    return device_flags(found, flags).agg(
        *[F.count_if(F.col(f"_did_{i}")).alias(f"users_{i}") for i in range(len(stages))]
    )


def funnel(events: DataFrame, bounds: Bounds, steps: list[str] = PURCHASE_STEPS) -> DataFrame:
    """Devices per step and the rate to the step before. Steps are independent, so a
    rate can exceed 100; it is 0 after an empty step."""
    counts = _step_counts(bounds.apply(events, "event_ts"), [Stage(s, s) for s in steps])
    rows = [
        {"step_no": F.lit(i + 1), "step": F.lit(step), "users": F.col(f"users_{i}"),
         "_before": F.lit(None).cast("bigint") if i == 0 else F.col(f"users_{i - 1}")}
        for i, step in enumerate(steps)
    ]
    first = F.col("step_no") == 1
    rate = F.when(first, F.lit(100.0)).otherwise(percent(F.col("users"), F.col("_before"), 2))
    return single_row_to_rows(counts, rows).select(
        "step_no", "step", "users", rate.alias("conversion_rate")
    )


def staged_funnel(
    events: DataFrame,
    stages: list[Stage] = SUBSCRIPTION_STAGES,
    as_of: datetime | None = None,
    days: int = 30,
) -> DataFrame:
    """Devices per stage; conversion and drop-off against the last earlier stage that
    had any, 100 and 0 when none had. The overall rate is last over first."""
    counts = _step_counts(clock.since_midnight(as_of, days).apply(events, "event_ts"), stages)
    last = len(stages) - 1
    rows = []
    for i, stage in enumerate(stages):
        earlier = [F.nullif(F.col(f"users_{j}"), F.lit(0)) for j in range(i - 1, -1, -1)]
        rows.append(
            {
                "stage_no": F.lit(i + 1),
                "stage": F.lit(stage.label),
                "users": F.col(f"users_{i}"),
                "_before": F.coalesce(*earlier, F.lit(0)),
                "_top": F.col("users_0"),
                "_bottom": F.col(f"users_{last}"),
            }
        )
    users, before = F.col("users"), F.col("_before")
    return single_row_to_rows(counts, rows).select(
        "stage_no",
        "stage",
        "users",
        percent(users, before, 1, empty=100.0).alias("conversion"),
        percent(before - users, before, 1).alias("drop_off"),
        percent(F.col("_bottom"), F.col("_top"), 2).alias("overall_conversion"),
    )
