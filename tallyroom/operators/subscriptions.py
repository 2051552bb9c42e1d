"""Revenue and subscriber metrics. Money stays decimal until one last division."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tallyroom import clock
from tallyroom.clock import Bounds
from tallyroom.functions import ratio
from tallyroom.functions.counts import n_distinct, n_rows
from tallyroom.plans import join_single_rows, order_by, single_row_to_rows

# Fixed values.
PRODUCTION = "PRODUCTION"
DEFAULT_TAKEHOME = 70
SUBSCRIPTION_MONTHS = 6


def _money(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)).cast("double")


def _production(subscriptions: DataFrame, *types: str) -> DataFrame:
    found = subscriptions.filter(F.col("environment") == PRODUCTION)
    return found.filter(F.col("event_type").isin(*types)) if types else found


def _initial(value: Column) -> Column:
    return F.when(F.col("event_type") == "INITIAL_PURCHASE", value)


def purchase_revenue(subscriptions: DataFrame, bounds: Bounds) -> DataFrame:
    bought = bounds.apply(_production(subscriptions, "INITIAL_PURCHASE"), "created_at")
    return bought.agg(_money(F.sum("price")).alias("total"), n_rows().alias("purchases"))


def users_by_tier(
    subscriptions: DataFrame, active: DataFrame, bounds: Bounds, column: str = "total_users"
) -> DataFrame:
    """Buyers in the window by tier; everyone else of the active users is free.
    ``active`` has one row with the number of active users in ``column``."""
    bought = bounds.apply(_production(subscriptions, "INITIAL_PURCHASE"), "created_at")
    tier = F.when(F.col("product_id").ilike("%max%"), F.lit("max")).otherwise(F.lit("pro"))
    per_tier = bought.groupBy(tier.alias("tier")).agg(n_distinct("app_user_id").alias("n"))
    sold = per_tier.agg(
        F.coalesce(F.sum(F.when(F.col("tier") == "pro", F.col("n"))), F.lit(0)).alias("_pro"),
        F.coalesce(F.sum(F.when(F.col("tier") == "max", F.col("n"))), F.lit(0)).alias("_max"),
    )
    one = join_single_rows(sold, active.select(F.col(column).alias("_active")))
    free = F.greatest(F.lit(0), F.col("_active") - F.col("_pro") - F.col("_max"))
    return single_row_to_rows(
        one,
        [{"tier": F.lit("free"), "count": free},
         {"tier": F.lit("pro"), "count": F.col("_pro")},
         {"tier": F.lit("max"), "count": F.col("_max")}],
    )


def subscription_event_summary(
    subscriptions: DataFrame, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    recent = clock.since(as_of, days).apply(subscriptions, "created_at")
    counts = recent.groupBy("event_type").agg(n_rows().alias("count"))
    return counts.orderBy(F.desc("count"), "event_type")


def mrr(subscriptions: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Monthly recurring revenue of the last 30 days after store fees, and subscribers.

    A plan is monthly by its period or, failing that, its product id; only then
    annual. The share kept is applied in decimals, the divisions come last.
    """
    period, product = F.col("period_type"), F.col("product_id")
    kept = F.col("price") * F.coalesce("takehome_percentage", F.lit(DEFAULT_TAKEHOME))
    monthly = F.coalesce((period == "MONTHLY") | product.like("%monthly%"), F.lit(False))
    annual = F.coalesce((period == "ANNUAL") | product.like("%yearly%"), F.lit(False))
    paid = clock.since(as_of, 30).apply(
        _production(subscriptions, "INITIAL_PURCHASE", "RENEWAL"), "created_at"
    )
    sums = paid.agg(
        _money(F.sum(F.when(monthly, kept))).alias("_monthly"),
        _money(F.sum(F.when(annual & ~monthly, kept))).alias("_annual"),
        n_distinct("app_user_id").alias("active_subscribers"),
    )
    value = F.col("_monthly") / 100 + F.col("_annual") / 1200
    return sums.select(value.alias("mrr"), "active_subscribers")


def churn_by_day(
    subscriptions: DataFrame, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    """Cancellations and expirations per day in every environment, newest day first."""
    lost = clock.since(as_of, days).apply(subscriptions, "created_at").filter(
        F.col("event_type").isin("CANCELLATION", "EXPIRATION")
    )
    per_day = lost.groupBy(F.to_date("created_at").alias("date")).agg(n_rows().alias("churn_count"))
    return per_day.orderBy(F.desc("date"))


def production_stats(subscriptions: DataFrame) -> DataFrame:
    """All-time purchasers, revenue and subscribers, from one row per user."""
    per_user = _production(subscriptions, "INITIAL_PURCHASE", "RENEWAL").groupBy("app_user_id").agg(
        F.max(F.col("event_type") == "INITIAL_PURCHASE").alias("_bought"),
        F.sum(_initial(F.col("price"))).alias("_revenue"),
    )
    known = F.col("app_user_id").isNotNull()
    return per_user.agg(
        F.count_if(known & F.col("_bought")).alias("total_purchases"),
        _money(F.sum("_revenue")).alias("total_revenue"),
        F.count_if(known).alias("active_subscribers"),
    )


def monetization(
    subscriptions: DataFrame, events: DataFrame, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    """Revenue, MRR and revenue per user in one row. Without users the divisor is 1."""
    bought = _production(subscriptions, "INITIAL_PURCHASE").agg(
        _money(F.sum("price")).alias("total_revenue"), n_distinct("app_user_id").alias("paying_users")
    )
    seen = clock.since(as_of, days).apply(events, "event_ts").agg(
        F.countDistinct("device_id").alias("_users")
    )
    one = join_single_rows(bought, mrr(subscriptions, as_of), seen)
    revenue, payers = F.col("total_revenue"), F.col("paying_users")
    users = F.greatest(F.col("_users"), F.lit(1))
    arppu = ratio(revenue, payers)
    return one.select(
        "total_revenue",
        "mrr",
        ratio(revenue, users).alias("arpu"),
        arppu.alias("arppu"),
        (arppu * SUBSCRIPTION_MONTHS).alias("ltv"),
        "paying_users",
        users.alias("total_users"),
        "active_subscribers",
    )


def revenue_trend(
    subscriptions: DataFrame, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    """Revenue of first purchases per day; a day with other events only has 0."""
    found = clock.since(as_of, days).apply(_production(subscriptions), "created_at")
    return (
        found.groupBy(F.to_date("created_at").alias("date"))
        .agg(_money(F.sum(_initial(F.col("price")))).alias("revenue"))
        .orderBy("date")
    )


def revenue_by_plan(subscriptions: DataFrame) -> DataFrame:
    plans = _production(subscriptions, "INITIAL_PURCHASE").groupBy("product_id").agg(
        n_rows().alias("purchases"), F.sum("price").cast("double").alias("revenue")
    )
    return plans.orderBy(order_by("revenue"), "product_id")


def subscriber_trend(
    subscriptions: DataFrame, as_of: datetime | None = None, days: int = 30
) -> DataFrame:
    """Distinct first-time buyers per day."""
    bought = clock.since(as_of, days).apply(
        _production(subscriptions, "INITIAL_PURCHASE"), "created_at"
    )
    per_day = bought.groupBy(F.to_date("created_at").alias("date"))
    return per_day.agg(n_distinct("app_user_id").alias("new_subscribers")).orderBy("date")


def revenue_today(subscriptions: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Sum of prices since midnight."""
    today = clock.since_midnight(as_of, 0).apply(subscriptions, "created_at")
    return today.agg(_money(F.sum("price")).alias("revenue_today"))
