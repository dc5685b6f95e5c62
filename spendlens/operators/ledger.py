"""Ledger questions: pages, summaries, trends, shares, budgets and the text of the advice context.

Ledgers have id, user_id, ts, date, amount, category, type. A null category is
one of its own, except in `advice_context`, where it counts as `Otros`. Empty
ledgers give empty results (`totals`: one row of nulls and a zero).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spendlens.functions import dates, rules
from spendlens.functions.numbers import half_up


def _sum(kind: str) -> Column:
    return F.sum(F.when(F.col("type") == kind, F.col("amount")).otherwise(0)).cast("double")


def summary(ledger: DataFrame, month: str, *keys: str) -> DataFrame:
    """spent, income and n of a month by `keys`; without keys one row. One scan, one shuffle of partial sums."""
    rows = ledger.where(dates.month_range(F.col("ts"), month))
    return rows.groupBy(*keys).agg(_sum("debit").alias("spent"), _sum("credit").alias("income"), F.count("*").alias("n"))


def summary_with_totals(ledger: DataFrame, month: str) -> DataFrame:
    """The month by user and category, and each user's total (category null, is_total), from one scan."""
    rows = ledger.where(dates.month_range(F.col("ts"), month))
    return (
        rows.groupingSets([["user_id", "category"], ["user_id"]], "user_id", "category")
        .agg(_sum("debit").alias("spent"), _sum("credit").alias("income"), F.count("*").alias("n"), (F.grouping("category") == 1).alias("is_total"))
    )


def trend(ledger: DataFrame, as_of: dt.datetime, months: int = 6) -> DataFrame:
    """Debits by month over the trailing months."""
    rows = ledger.where(dates.trailing_months(F.col("ts"), as_of, months) & (F.col("type") == "debit"))
    return rows.groupBy(dates.month_key(F.col("date")).alias("month")).agg(F.sum("amount").cast("double").alias("total"))


def category_months(ledger: DataFrame, as_of: dt.datetime, months: int = 3, *keys: str) -> DataFrame:
    """Debits by `keys`, category and month over the trailing months."""
    rows = ledger.where(dates.trailing_months(F.col("ts"), as_of, months) & (F.col("type") == "debit"))
    return rows.groupBy(*keys, "category", dates.month_key(F.col("date")).alias("month")).agg(F.sum("amount").cast("double").alias("total"))


def entries_of(ledger: DataFrame, user_id: int, month: str | None = None, category: str | None = None) -> DataFrame:
    """A user's entries, of a month and a category if given."""
    rows = ledger.where(F.col("user_id") == user_id)
    if month:
        rows = rows.where(dates.month_range(F.col("ts"), month))
    return rows.where(F.col("category") == category) if category else rows


def page(ledger: DataFrame, user_id: int, limit: int = 50, offset: int = 0, month: str | None = None, category: str | None = None) -> DataFrame:
    """One page of a user's entries, newest first, ties by id; optional month and category."""
    return entries_of(ledger, user_id, month, category).orderBy(F.col("date").desc(), F.col("id").desc()).offset(offset).limit(limit)


def page_with_total(ledger: DataFrame, user_id: int, limit: int = 50, offset: int = 0, month: str | None = None, category: str | None = None) -> DataFrame:
    """One row: total, how many entries there are, and transactions, the page of them in order (empty beyond the end)."""
    listed = page(ledger, user_id, limit, offset, month, category).select("date", "id", F.struct("*").alias("row"))
    on_page = listed.agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "id", "row")), asc=False), lambda x: x["row"]).alias("transactions"))  # a page: `limit` rows
    return entries_of(ledger, user_id, month, category).agg(F.count("*").alias("total")).join(on_page)


def owned(rows: DataFrame, row_id: int, user_id: int, key: str = "id") -> DataFrame:
    """The row of an id, if it is the user's own."""
    return rows.where((F.col(key) == row_id) & (F.col("user_id") == user_id))


def count_entries(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(F.count("*").alias("total"))


def shares(by_category: DataFrame) -> DataFrame:
    """Each category's percentage of its user's spending (columns user_id, category, spent, income)."""
    total = F.sum("spent").over(W.partitionBy("user_id"))
    return by_category.where("spent > 0").select("user_id", "category", "spent", (F.col("spent") / total * 100).alias("share"))


def top_categories(by_category: DataFrame, n: int = 8, of: str = "spent") -> DataFrame:
    """Each user's first n categories with spending (or, of="income", with income), the largest sum of both first; ties by name."""
    order = W.partitionBy("user_id").orderBy((F.col("spent") + F.col("income")).desc(), "category")
    return by_category.where(F.col(of) > 0).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def budget_status(by_category: DataFrame, budgets: DataFrame) -> DataFrame:
    """Spending against each budget: tier ok, warn (75 %) or danger (100 %), bar (100 at most) and over (above 100 only)."""
    spent = F.coalesce(F.col("spent"), F.lit(0.0))
    share = F.when(F.col("budget") > 0, spent / F.col("budget").cast("double") * 100).otherwise(0.0)
    return (
        budgets.join(by_category.select("user_id", "category", "spent"), ["user_id", "category"], "left")
        .withColumn("spent", spent).withColumn("percent", share)
        .select(
            "user_id", "category", F.col("budget").cast("double").alias("budget"), "spent",
            F.when(F.col("percent") >= 100, "danger").when(F.col("percent") >= 75, "warn").otherwise("ok").alias("tier"),
            F.least("percent", F.lit(100.0)).alias("bar"), F.when(F.col("percent") > 100, half_up(F.col("spent") - F.col("budget").cast("double"))).alias("over"),
        )
    )


def new_alerts(status: DataFrame, month: str) -> DataFrame:
    """Categories whose spending is above their budget, once per user, month and category; a budget of nothing is none."""
    above = status.where("budget > 0 and spent > budget").withColumn("over", half_up(F.col("spent") - F.col("budget")))
    return above.select("user_id", F.lit(month).alias("month"), "category", "over").dropDuplicates(["user_id", "month", "category"])


def spending_pace(ledger: DataFrame, as_of: dt.datetime, months: int) -> DataFrame:
    """Each user's average monthly spending (absolute debits) over the trailing months, and the current month's."""
    rows = ledger.where(dates.trailing_months(F.col("ts"), as_of, months) & (F.col("type") == "debit"))
    monthly = rows.groupBy("user_id", F.trunc("date", "MM").alias("month")).agg(F.sum(F.abs("amount")).alias("total"))
    now = F.lit(as_of.date().replace(day=1))
    return monthly.groupBy("user_id").agg(
        (F.sum("total").cast("double") / F.count("*")).alias("avg_monthly"), F.coalesce(F.max(F.when(F.col("month") == now, F.col("total"))).cast("double"), F.lit(0.0)).alias("current_month")
    )


def surplus(pace: DataFrame) -> DataFrame:
    """What a user spent less than usual this month; 0 if not less."""
    less = (F.col("avg_monthly") > 0) & (F.col("current_month") < F.col("avg_monthly"))
    return pace.withColumn("surplus", F.when(less, half_up(F.col("avg_monthly") - F.col("current_month"))).otherwise(0))


def month_maps(by_month: DataFrame) -> DataFrame:
    """user_id, month, spending map<category, total>; a null category and `Otros` add up."""
    named = by_month.groupBy("user_id", "month", F.coalesce("category", F.lit(rules.OTHER_CATEGORY)).alias("category")).agg(F.sum("total").alias("total"))
    return named.groupBy("user_id", "month").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "total")))).alias("spending"))


def advice_context(by_month: DataFrame, subscriptions: DataFrame, goals: DataFrame) -> DataFrame:
    """Each user's months (newest first), active subscriptions and open goals as text. Users without spending have none."""
    whole = lambda c: half_up(c).cast("string")
    months = month_maps(by_month).select(
        "user_id", "month", F.concat("month", F.lit(":\n"), F.array_join(F.transform(F.map_entries("spending"), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), whole(e["value"]))), "\n")).alias("block")
    )
    months = months.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("month", "block")), asc=False), lambda x: x["block"]), "\n").alias("months"))
    subs = subscriptions.where("is_active").groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce(whole(F.col("amount").cast("double")), F.lit("?"))))), "\n").alias("subs")
    )
    wanted = goals.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- goal "), F.col("goal_id").cast("string"), F.lit(": "), whole(F.col("target_amount").cast("double"))))), "\n").alias("open"))
    joined = months.join(subs, "user_id", "left").join(wanted, "user_id", "left")
    return joined.select("user_id", F.concat_ws("\n\n", "months", F.coalesce("subs", F.lit("-")), F.coalesce("open", F.lit("-"))).alias("context"))
