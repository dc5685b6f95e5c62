"""Rate windows and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spendlens import shared
from spendlens.operators import plans_state

from .files import results, run


def run_rate_windows(events: DataFrame, minutes: int = 15, limit: int = 100, late: str = "1 hour", base: str | None = None) -> DataFrame:
    """`rate_windows` of a stream whose `ts` may be late by `late`; the last batch's update of a window counts."""
    spark, base = events.sparkSession, base or shared.new_path(events.sparkSession, "stream")
    rows = plans_state.rate_windows(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), minutes, limit)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    run(rows, "update", base, schema)
    newest = results(spark, base, schema).groupBy("window_start", "user_id").agg(F.max_by(F.struct("requests", "rejected"), "batch").alias("r"))
    return newest.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "r.requests", "r.rejected")


def run_progress(events: DataFrame, *keys: str, base: str | None = None) -> DataFrame:
    """Running totals (n, total of `value`) by `keys`: a batch writes the keys it changes, the last of each counts."""
    spark, base = events.sparkSession, base or shared.new_path(events.sparkSession, "stream")
    totals = events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("total"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in totals.schema)
    run(totals, "update", base, schema)
    newest = results(spark, base, schema).groupBy(*keys).agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return newest.select(*keys, "r.n", "r.total")
