"""Upcoming charges and reminders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spendlens.functions import dates

HORIZON = 30
BATCH = 100
#: Users whose messages are numbered together; batches of BATCH are cut within.
TOGETHER = 10_000


def upcoming(subscriptions: DataFrame, bills: DataFrame, as_of: dt.date, horizon: int = HORIZON) -> DataFrame:
    """Active subscriptions with a billing day and active bills that fall due within the horizon. Due today means next month."""
    both = (
        subscriptions.where("is_active and billing_day is not null").select("user_id", "id", "name", "amount", F.col("billing_day").alias("day"), F.lit("subscription").alias("kind"))
        .unionByName(bills.where("is_active").select("user_id", "id", "name", "amount", F.col("due_day").alias("day"), F.lit("bill").alias("kind")))
    )
    today = F.lit(as_of)
    rows = both.withColumn("next_date", dates.next_due(F.col("day"), today)).withColumn("days", F.datediff("next_date", today))
    return rows.where(F.col("days") <= horizon).select("user_id", "kind", "id", "name", F.col("amount").cast("double").alias("amount"), "next_date", "days")


def due_soon(calendar: DataFrame, days: int = 7, urgent: int = 3) -> DataFrame:
    return calendar.where(F.col("days") <= days).withColumn("urgent", F.col("days") <= urgent)


def is_push_token(token: Column) -> Column:
    return F.coalesce(token.startswith("ExponentPushToken["), F.lit(False))


def reminders(bills: DataFrame, users: DataFrame, as_of: dt.date) -> DataFrame:
    """Messages for bills due in exactly their reminder days, to users with a valid token, in batches of 100 within ranges of users."""
    days = dates.days_until(F.col("due_day"), F.lit(as_of))
    due = bills.where(F.col("is_active")).withColumn("days", days).where(F.col("days") == F.col("reminder_days")).withColumnRenamed("name", "bill")
    sent = due.join(users.where(is_push_token(F.col("push_token"))).select("user_id", "push_token"), "user_id")
    lot = F.floor(F.col("user_id") / TOGETHER)
    place = F.row_number().over(W.partitionBy(lot).orderBy("user_id", "id")) - 1
    return sent.select("user_id", "id", "bill", "days", "push_token", lot.alias("lot"), F.floor(place / BATCH).alias("batch"))
