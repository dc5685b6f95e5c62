"""Searches whose results grow as stores arrive: the best offers so far and statistics that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spendlens import shared
from spendlens.functions.numbers import half_up
from spendlens.operators import offers as op

from .files import run

_TOP = "query string, level string, store_id long, ordinal long, name string, price double, score int"
_STATS = "query string, level string, store_id long, n long, low double, high double, sum double"


def _found(offers: DataFrame, queries: list[str]) -> DataFrame:
    """The offers that queries find strictly, loosely, or because they have no keywords; which level counts is known at the end only.

    The names that are found are written: the planner then knows how few they are, and offers needn't be dealt by name, of which many share one.
    """
    asked, index = op.with_keywords(offers, queries), op.name_index(offers)
    worded = asked.where(F.size("words") > 0)
    names = shared.written(op.judged_strictly(index, worded).withColumn("level", F.lit("strict")).unionByName(op.judged_loosely(index, worded).withColumn("level", F.lit("loose"))), "judged")
    every = asked.where(F.size("words") == 0).select("query", F.lit(0).alias("score"), F.lit("every").alias("level"))
    return offers.join(names, "name").unionByName(offers.join(F.broadcast(every)))  # a few typed searches: offers are read once, not once for each of their partitions


def run_search(offers: DataFrame, queries: list[str], limit: int = 24, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The `limit` best offers of each query as `search` gives them, and `price_stats`, over all offers of a stream (store_id, ordinal, name, price).

    Batch n reads version n - 1 of two small tables and writes version n: the best
    `limit` offers of each query and level, a bounded heap, and a row of mergeable
    statistics for each query, level and store. A batch's offers are cut to `limit`
    and summed before they meet the tables. `after` gives the results after any batch.
    """
    spark, base = offers.sparkSession, base or shared.new_path(offers.sparkSession, "stream")
    order = W.partitionBy("query", "level").orderBy(F.col("score").desc(), "price", "ordinal", "store_id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")

    def merge(batch: DataFrame, n: int) -> None:
        found = shared.written(_found(batch, queries).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in _TOP.split(", "))), "found")
        top, stats = _version(spark, base, n - 1)
        best(top.unionByName(best(found))).write.mode("overwrite").parquet(f"{base}/top/{n}")
        new = found.groupBy("query", "level", "store_id").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.sum("price").alias("sum"))
        merged = stats.unionByName(new).groupBy("query", "level", "store_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("sum").alias("sum"))
        merged.write.mode("overwrite").parquet(f"{base}/stats/{n}")
        spark.createDataFrame([(n,)], "n long").write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    run(offers, "append", base, "n long", merge)
    last = spark.read.parquet(f"{base}/out").agg(F.max("n")).first()[0]
    return after(spark, base, -1 if last is None else last)


def _version(spark: SparkSession, base: str, n: int) -> tuple[DataFrame, DataFrame]:
    if n < 0:
        return spark.createDataFrame([], _TOP), spark.createDataFrame([], _STATS)
    return spark.read.schema(_TOP).parquet(f"{base}/top/{n}"), spark.read.schema(_STATS).parquet(f"{base}/stats/{n}")


def after(spark: SparkSession, base: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The best offers and the statistics after batch n (-1: before the first)."""
    top, stats = _version(spark, base, n)
    strict = stats.where("level = 'strict'").select("query").distinct()
    counts = lambda rows: rows.join(strict.withColumn("any_strict", F.lit(True)), "query", "left").where("level <> 'loose' or any_strict is null").drop("any_strict")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "price", "ordinal", "store_id")
    listed = counts(top).withColumn("place", F.row_number().over(order)).select("query", "place", "store_id", "name", "price", "score")
    summed = counts(stats).groupBy("query").agg(
        F.min("low").alias("min_price"), F.max("high").alias("max_price"), half_up(F.sum("sum") / F.sum("n")).alias("avg_price"), F.sum("n").alias("n"), F.count("*").alias("stores")
    )
    return listed, summed
