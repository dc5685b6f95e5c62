"""Finance relations as views over the given tables; every column is derived from a key or a measure of a row.

None of them shuffles but `offers`, so filters and column pruning reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from spendlens.functions.numbers import rounded

MONEY = "decimal(14,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ledger: id, user_id, ts, date, amount, category, type; purchases are credits."""
    return ledger_of(table(spark, sf_dir, "events"))


def ledger_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), "user_id", "ts", F.to_date("ts").alias("date"), F.col("value").cast(MONEY).alias("amount"),
        F.col("event_type").alias("category"), F.when(F.col("event_type") == "purchase", "credit").otherwise("debit").alias("type"),
    )


def long_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ledger over years: orders by customer; open orders are credits."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").cast(MONEY).alias("amount"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "O", "credit").otherwise("debit").alias("type"),
    )


def unit_price() -> Column:
    return rounded(F.col("l_extendedprice") / F.col("l_quantity"), 2).cast(MONEY)


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated charges: the parts that a supplier's line items name, at unit price."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("description"), unit_price().alias("amount"), F.lit("debit").alias("type"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription per part, held by the user part modulo 150."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), (key % 150).alias("user_id"), F.concat(F.lit("PART-"), key.cast("string"), F.lit("!")).alias("name"),
        F.when(key % 13 != 0, F.col("p_retailprice").cast(MONEY)).alias("amount"), F.when(key % 5 == 0, "yearly").when(key % 5 == 1, "weekly").otherwise("monthly").alias("frequency"),
        F.when(key % 7 != 0, (1 + key % 31).cast("int")).alias("billing_day"), (key % 11 != 0).alias("is_active"),
    )


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"), (key % 150).alias("user_id"), F.col("s_name").alias("name"), F.abs("s_acctbal").cast(MONEY).alias("amount"),
        (1 + key % 31).cast("int").alias("due_day"), (1 + key % 10).cast("int").alias("reminder_days"), (key % 9 != 0).alias("is_active"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"), F.col("c_name").alias("name"),
        F.when(key % 4 == 0, None).when(key % 4 == 1, F.concat(F.lit("web:"), key.cast("string"))).otherwise(F.concat(F.lit("ExponentPushToken["), key.cast("string"), F.lit("]"))).alias("push_token"),
        F.when(key % 3 == 0, "premium").otherwise("free").alias("plan"),
        F.when(key % 6 == 0, F.make_timestamp_ntz(F.lit(2024), F.lit(1), (1 + key % 28).cast("int"), F.lit(0), F.lit(0), F.lit(0))).alias("plan_expires_at"),
    )


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One goal per customer; what it holds is the sum of its deposits."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("goal_id"), key.alias("user_id"), (F.abs("c_acctbal") + 500).cast(MONEY).alias("target_amount"),
        F.when(key % 5 != 0, F.date_add(F.lit("2024-01-15").cast("date"), (key % 300).cast("int"))).alias("target_date"),
    )


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("goal_id"), F.col("value").cast(MONEY).alias("amount"), F.col("ts").alias("created_at")
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget for most users and each spending category."""
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer").where(key % 10 != 0)
        .select(key.alias("user_id"), F.explode(F.array(*map(F.lit, ("view", "signup", "error", "click")))).alias("category"))
        .withColumn("budget", (F.lit(1000) + F.col("user_id") % 7 * 500).cast("decimal(12,2)"))
    )


def store_kind(store: Column) -> Column:
    """A store's number in the registry of twelve."""
    return (store % 12).cast("int")


def offers(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """What each store (supplier) asks for each part: the lowest unit price; the ordinal is the part's key. With `first` only each store's parts of so many least keys.

    These are picked from the line items themselves: scans keep a store's least keys
    before any row is dealt, so that a task sorts no more than what it reads.
    """
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("ordinal"), "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"))
    if first:
        place = F.dense_rank().over(W.partitionBy("store_id").orderBy("ordinal"))
        sold = sold.join(parts.select("ordinal"), "ordinal", "left_semi").withColumn("place", place).where(F.col("place") <= first)
    items = sold.groupBy("store_id", "ordinal").agg(F.min(unit_price()).alias("price"))
    return items.join(parts, "ordinal").select("store_id", "ordinal", "name", F.col("price").cast("double").alias("price"))


def plan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan events: seq, type, user_id, expiration_ms."""
    return plan_events_of(table(spark, sf_dir, "events"))


def plan_events_of(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    kind = F.when(key % 5 == 0, "INITIAL_PURCHASE").when(key % 5 == 1, "RENEWAL").when(key % 5 == 2, "EXPIRATION").when(key % 5 == 3, "CANCELLATION").otherwise("TEST")
    return events.select(
        key.alias("seq"), kind.alias("type"), "user_id", "ts", F.when(key % 2 == 0, F.lit(1_706_745_600_000) + key * 1000).alias("expiration_ms")
    )
