"""Recurring charges: candidates, price alerts, known merchants and subscription totals.

Charges are summed by user and description first, each distinct description is
normalised once, and a user with very many charges is summed in many tasks.
Names that contain one another are found by their rarest gram among the user's
names (`gram_index`). Nulls: a null description has no key and is no candidate;
a null amount is no charge.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from spendlens import shared
from spendlens.functions import dates, text
from spendlens.functions.numbers import half_up

from . import gram_index

LEAST_GAP, MOST_GAP = 20, 60
DEVIATION = 0.15
RISE = 1.02


def candidates(charges: DataFrame, registered: DataFrame, as_of: dt.datetime, months: int = 4, top: int = 10) -> DataFrame:
    """Groups of a user's debits with one key that recur: two or more, 20 to 60 days apart on average, within 15 % of their mean.

    Names that are registered already (user_id, name), or contain or are
    contained in such a name, go. The `top` largest of each user. Gaps and
    deviations need only the group's extremes, so one partial aggregation does.
    """
    rows = charges.where((F.col("type") == "debit") & (F.col("amount") > 0) & dates.trailing_months(F.col("ts"), as_of, months))
    amount, day = F.col("amount").cast("double"), F.to_date("ts")
    described = rows.groupBy("user_id", "description").agg(
        F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), F.sum(amount).alias("sum"), F.max(amount).alias("high"), F.min(amount).alias("low"), F.max(F.struct("ts", "id")).alias("at")
    )
    groups = (
        described.withColumn("key", text.subscription_key("description")).where(F.length("key") >= 3).groupBy("user_id", "key")
        .agg(F.sum("n").alias("occurrences"), F.min("first").alias("first"), F.max("last").alias("last_charge"), (F.sum("sum") / F.sum("n")).alias("mean"),
             F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("description", "at").alias("description"))
        .where("occurrences >= 2")
    )
    gap = F.datediff("last_charge", "first") / (F.col("occurrences") - 1)
    steady = groups.where(gap.between(LEAST_GAP, MOST_GAP) & (F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low")) / F.col("mean") <= DEVIATION))
    steady = shared.written(steady, "steady")  # few of the groups, read three times
    known = registered.select("user_id", "name").distinct().select("user_id", text.subscription_key("name").alias("name_key")).distinct()
    taken = gram_index.either_containing(steady.select("user_id", "key"), known, "key", "name_key", "user_id").select("user_id", "key").distinct()
    fresh = steady.join(taken, ["user_id", "key"], "left_anti")
    order = W.partitionBy("user_id").orderBy(F.col("amount").desc(), "key")
    return (
        fresh.withColumn("amount", half_up(F.col("mean"))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
        .select("user_id", "key", "description", "amount", "occurrences", "last_charge")
    )


def latest_charges(subscriptions: DataFrame, charges: DataFrame, as_of: dt.datetime, months: int = 2) -> DataFrame:
    """Active subscriptions with an amount, and the latest matching debit of their user, if any."""
    rows = charges.where((F.col("type") == "debit") & (F.col("amount") > 0) & dates.trailing_months(F.col("ts"), as_of, months))
    described = rows.groupBy("user_id", "description").agg(F.max(F.struct("ts", "id", "amount")).alias("last"))
    paid = described.withColumn("key", text.subscription_key("description")).where("key is not null").groupBy("user_id", "key").agg(F.max("last").alias("last"))
    paid = shared.written(paid, "paid")  # read once as the shorter names and once as the longer
    subs = subscriptions.where("is_active and amount is not null").select("id", "user_id", "name", "amount")
    names = subs.select("id", "user_id", text.subscription_key("name").alias("name_key")).where("name_key is not null")
    last = gram_index.either_containing(names, paid, "name_key", "key", "user_id").groupBy("id", "user_id").agg(F.max("last").alias("last"))
    return subs.join(last, ["id", "user_id"], "left").select("id", "user_id", "name", "amount", F.col("last.amount").alias("last_amount"))


def price_alerts(latest: DataFrame) -> DataFrame:
    """Subscriptions last charged over 2 % more than registered."""
    last, own = F.col("last_amount").cast("double"), F.col("amount").cast("double")
    return latest.where(last > own * RISE).select("id", "user_id", "name", own.alias("registered"), last.alias("last_amount"), half_up(last - own).alias("difference"))


def totals(subscriptions: DataFrame) -> DataFrame:
    """Each user's active monthly subscriptions: monthly and yearly cost, and a fifth of the monthly one as what could be saved."""
    monthly = F.coalesce(F.sum(F.when(F.col("is_active") & (F.col("frequency") == "monthly"), F.col("amount"))).cast("double"), F.lit(0.0))
    return subscriptions.groupBy("user_id").agg(monthly.alias("monthly"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive")).select(
        "user_id", "monthly", (F.col("monthly") * 12).alias("yearly"), half_up(F.col("monthly") * 0.2).alias("optimisable"), "active", "inactive"
    )


def known_merchants(charges: DataFrame) -> DataFrame:
    """Each user's known merchants with the latest charge; of charges at one time the first seen (least id) counts."""
    rows = charges.where("type = 'debit'").withColumn("merchant", text.merchant(F.col("description"))).where("merchant is not null")
    return rows.groupBy("user_id", "merchant").agg(
        F.max_by(F.col("amount").cast("double"), F.struct("date", -F.col("id"))).alias("amount"), F.max("date").alias("last_charged"), F.count("*").alias("charges")
    )


def without_dismissed(candidates: DataFrame, dismissed: DataFrame) -> DataFrame:
    """The candidates (user_id, description, ...) that their user hasn't dismissed (user_id, description); null descriptions stay."""
    return candidates.join(dismissed.select("user_id", "description").distinct(), ["user_id", "description"], "left_anti")


def billing_days(charges: DataFrame) -> DataFrame:
    """user_id, description, billing_day: the day of the month of each description's last charge."""
    return charges.where("type = 'debit'").groupBy("user_id", "description").agg(F.dayofmonth(F.max("date")).alias("billing_day"))


def by_flag(rows: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose flag is true, and the others (null counts as false)."""
    isset = F.coalesce(F.col(flag), F.lit(False))
    return rows.where(isset), rows.where(~isset)
