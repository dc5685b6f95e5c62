"""Plan state from events, entitlement and rate windows, for whole tables; `streaming` has the incremental forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from spendlens.functions import dates, rules


def states(events: DataFrame) -> DataFrame:
    """Events that change the plan, with state struct<plan, expires_at>; others go."""
    grants, revokes = F.col("type").isin(rules.GRANTS), F.col("type").isin(rules.REVOKES)
    expires = F.when(grants & F.col("expiration_ms").isNotNull(), F.timestamp_millis("expiration_ms").cast("timestamp_ntz"))
    return events.where(grants | revokes).withColumn("state", F.struct(F.when(grants, "premium").otherwise("free").alias("plan"), expires.alias("expires_at")))


def plan_state(events: DataFrame) -> DataFrame:
    """user_id, plan, expires_at after all events: the last to arrive (seq) wins."""
    last = states(events).groupBy("user_id").agg(F.max_by("state", "seq").alias("s"), F.count("*").alias("changes"))
    return last.select("user_id", "s.plan", "s.expires_at", "changes")


def entitled(plan: Column, expires_at: Column, as_of: dt.datetime) -> Column:
    return (plan == "premium") & (expires_at.isNull() | (expires_at > dates.at(as_of)))


def rate_windows(events: DataFrame, minutes: int = 15, limit: int = 100) -> DataFrame:
    """Requests of each user by fixed window, and how many were over the limit."""
    counted = events.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "user_id").agg(F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), "user_id", "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


#: What a plan opens.
FLAGS = ["isPremium", "canUpload", "canUseAI", "canComparePrices", "canAddGoal", "canAddBill", "canShopping"]


def flags(premium):
    """The feature flags of a plan, each open to premium users only."""
    return F.struct(*(premium.alias(name) for name in FLAGS))
