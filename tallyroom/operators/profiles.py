"""Snapshot maintenance of user profiles from ordered change feeds."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from tallyroom import clock
from tallyroom.functions import normalize_phone

TEXT_COLUMNS = [
    "rc_user_id", "email", "phone", "display_name", "subscription_tier", "preferred_contact",
]
FLAG_COLUMNS = ["opted_in_marketing", "opted_in_product_updates", "opted_in_receipts"]


def _now(as_of: datetime | None) -> Column:
    return F.lit(clock.resolve(as_of).replace(tzinfo=timezone.utc))


def _latest(value: Column, seq: str = "seq") -> Column:
    """The last non-null value of a feed."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(seq)))


def merge_profiles(
    current: DataFrame, changes: DataFrame, as_of: datetime | None = None
) -> DataFrame:
    """Upsert by device. Per column the last given value wins; null, and empty text,
    keep the old one, while ``false`` is a value. New profiles start unverified."""
    given = {
        **{c: F.nullif(F.col(c), F.lit("")) for c in TEXT_COLUMNS},
        **{c: F.col(c) for c in FLAG_COLUMNS},
    }
    latest = (
        changes.filter(F.nullif(F.col("device_id"), F.lit("")).isNotNull())
        .groupBy("device_id")
        .agg(*[_latest(value).alias(f"_new_{c}") for c, value in given.items()])
        .withColumn("_changed", F.lit(True))
    )
    now = _now(as_of)
    joined = current.withColumn("_known", F.lit(True)).join(latest, "device_id", "full_outer")
    merged = {c: F.coalesce(f"_new_{c}", c) for c in given}
    fresh = F.col("_known").isNull()
    for flag in ("email_verified", "phone_verified"):
        merged[flag] = F.when(fresh, F.lit(False)).otherwise(F.col(flag))
    merged["created_at"] = F.when(fresh, now).otherwise(F.col("created_at"))
    merged["updated_at"] = F.when(F.col("_changed"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(merged).select(*current.columns)


def delete_profiles(current: DataFrame, device_ids: DataFrame) -> DataFrame:
    return current.join(device_ids.select("device_id"), "device_id", "left_anti")


def apply_phone_changes(
    current: DataFrame, changes: DataFrame, as_of: datetime | None = None
) -> DataFrame:
    """Verification feed with ``device_id, kind, phone, seq``.

    ``sent`` stores the number, unverified, creating the profile if need be;
    ``approved`` verifies an existing profile and is ignored without one. Changes
    without a device are left out.
    """
    sent, approved = F.col("kind") == "sent", F.col("kind") == "approved"
    number = normalize_phone(F.nullif(F.col("phone"), F.lit("")))
    changes = changes.filter(F.coalesce("device_id", F.lit("")) != "")
    latest = changes.groupBy("device_id").agg(
        F.max(F.when(sent, F.col("seq"))).alias("_sent"),
        F.max(F.when(approved, F.col("seq"))).alias("_approved"),
        _latest(number).alias("_phone"),
    )
    now = _now(as_of)
    joined = current.withColumn("_known", F.lit(True)).join(latest, "device_id", "full_outer")
    joined = joined.filter(F.col("_known") | F.col("_sent").isNotNull())
    fresh = F.col("_known").isNull()
    changed = F.col("_sent").isNotNull() | F.col("_approved").isNotNull()
    verified = (
        F.when(
            F.col("_approved").isNotNull()
            & (F.col("_sent").isNull() | (F.col("_approved") > F.col("_sent"))),
            F.lit(True),
        )
        .when(F.col("_sent").isNotNull(), F.lit(False))
        .otherwise(F.col("phone_verified"))
    )
    merged = {
        "phone": F.coalesce("_phone", "phone"),
        "phone_verified": verified,
        "created_at": F.when(fresh, now).otherwise(F.col("created_at")),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
    }
    merged["email_verified"] = F.when(fresh, F.lit(False)).otherwise(F.col("email_verified"))
    return joined.withColumns(merged).select(*current.columns)


def subscriber_overview(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        F.count(F.lit(1)).alias("total_profiles"),
        F.count("email").alias("with_email"),
        F.count("phone").alias("with_phone"),
        F.count_if("opted_in_marketing").alias("marketing_opt_in"),
    )


def subscribers_by_tier(profiles: DataFrame) -> DataFrame:
    known = profiles.filter(F.col("subscription_tier").isNotNull())
    return known.groupBy("subscription_tier").agg(F.count(F.lit(1)).alias("count"))
