"""Savings goals: projection, quota, streak and milestones.

A goal without deposits is `no_data`; deposits without a goal are ignored.
Times are explicit; a month is 30.44 days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spendlens.functions.dates import MONTH_DAYS
from spendlens.functions.numbers import half_up

LONGEST_STREAK = 365


def streaks(deposits: DataFrame, as_of: dt.date) -> DataFrame:
    """goal_id, streak: consecutive days with a deposit up to today or yesterday. Goals without one are absent."""
    days = deposits.select("goal_id", F.to_date("created_at").alias("day")).where(F.col("day") <= F.lit(as_of)).distinct()
    island = F.date_sub("day", F.row_number().over(W.partitionBy("goal_id").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("goal_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.where(F.col("last") >= F.date_sub(F.lit(as_of), 1)).select("goal_id", F.least("n", F.lit(LONGEST_STREAK)).alias("streak"))


def monthly_quota(remaining: Column, target: Column, as_of: Column) -> Column:
    """What to save each month until the target date: null without a date ahead, 0 if nothing remains."""
    months = F.datediff(target, as_of) / F.lit(MONTH_DAYS)
    return F.when(target.isNull() | (target <= as_of), F.lit(None)).when(remaining <= 0, F.lit(0)).otherwise(F.ceil(remaining / months)).cast("long")


def insights(goals: DataFrame, deposits: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row per goal (goal_id, user_id, target_amount, target_date): status, pace, projection, quota, streak and milestones.

    Deposits are summed per goal before the join, so a busy goal shuffles one row a task.
    """
    sums = deposits.groupBy("goal_id").agg(F.sum("amount").cast("double").alias("current"), F.min("created_at").alias("first"), F.count("*").alias("n"))
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    rows = goals.join(sums, "goal_id", "left").join(streaks(deposits, as_of.date()), "goal_id", "left")
    target, current = F.col("target_amount").cast("double"), F.coalesce("current", F.lit(0.0))
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))
    pace = F.col("current") / F.greatest(seconds / F.lit(86400 * MONTH_DAYS), F.lit(1.0))
    rows = rows.withColumn("status", F.when(current >= target, "completed").when(F.col("n").isNull() | (pace <= 0), "no_data").otherwise("ok"))
    ok = F.col("status") == "ok"
    left = F.greatest((target - current) / pace, F.lit(0.5))
    share = current / target
    return rows.select(
        "goal_id", "user_id", "status", current.alias("current"), F.when(ok, half_up(pace)).alias("avg_per_month"), F.when(ok, half_up(left * 10) / 10).alias("months_left"),
        F.when(ok, F.date_add(now.cast("date"), half_up(left * MONTH_DAYS).cast("int"))).alias("projected_date"),
        monthly_quota(target - current, F.col("target_date"), now.cast("date")).alias("quota"), F.coalesce("streak", F.lit(0)).cast("long").alias("streak"),
        *((share >= q / 100).alias(f"p{q}") for q in (25, 50, 75, 100)),
    )


def with_surplus(insight: DataFrame, surplus: DataFrame) -> DataFrame:
    """Insights with what the goal's user spent less than usual (`ledger.surplus`), the same for all of a user's goals; 0 without spending."""
    return insight.join(surplus.select("user_id", "surplus"), "user_id", "left").withColumn("surplus", F.coalesce("surplus", F.lit(0)).cast("long"))


def totals(insight: DataFrame, goals: DataFrame) -> DataFrame:
    """Each user's saved and wanted sums, their ratio and the open and completed goals."""
    rows = insight.join(goals.select("goal_id", F.col("target_amount").cast("double").alias("target")), "goal_id")
    return rows.groupBy("user_id").agg(
        F.sum("current").alias("saved"), F.sum("target").alias("wanted"), F.try_divide(F.sum("current"), F.sum("target")).alias("ratio"),
        F.count_if(F.col("status") != "completed").alias("open"), F.count_if(F.col("status") == "completed").alias("completed"),
    )


def over_quota(users: DataFrame, goals: DataFrame, free_goals: int = 1) -> DataFrame:
    """Users without the paid plan who may not add a goal; the plan's expiry isn't looked at here."""
    counts = goals.groupBy("user_id").agg(F.count("*").alias("goals"))
    return users.join(counts, "user_id").where((F.col("plan") != "premium") & (F.col("goals") >= free_goals)).select("user_id", "goals")


def deposits_of(goals: DataFrame, deposits: DataFrame, goal_id: int, user_id: int, n: int = 50) -> DataFrame:
    """The n newest deposits of a goal that is the user's own; ties by id."""
    own = goals.where((F.col("goal_id") == goal_id) & (F.col("user_id") == user_id)).select("goal_id")
    return deposits.join(own, "goal_id", "left_semi").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
