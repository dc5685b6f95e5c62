"""Alerts when a month's spending in a category goes above its budget, one for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spendlens import shared
from spendlens.functions import dates

from .files import Versions, results, run

_KEYS = ["user_id", "month", "category"]
_OUT = "user_id long, month string, category string, spent double, budget double, at timestamp"
#: A month's sum in cents, its newest entry, whether it has been sent, and whether this batch sends it.
_STATE = "user_id long, month string, category string, cents long, budget_cents long, at_ms long, sent boolean, alert boolean"
#: The newest entry so far, and the watermark that a batch ran with.
_CLOCK = "at_ms long, mark_ms long"


def run_budget_alerts(ledger: DataFrame, budgets: DataFrame, late: str = "40 days", keep_ms: int = 62 * 86_400_000, base: str | None = None) -> tuple[DataFrame, int]:
    """user_id, month, category, spent, budget of each first time above a budget, and the number of rows that came too late.

    `ledger` is a stream (user_id, ts, amount, category, type), `budgets` a table (user_id, category, budget).
    Rows are late that are `late` or more behind the newest of the batches before. A sum, and with it
    that its alert has been sent, is forgotten `keep_ms` after its newest entry, by the same clock.
    """
    spark, base = ledger.sparkSession, base or shared.new_path(ledger.sparkSession, "stream")
    debits = ledger.where("type = 'debit'").select("user_id", "category", F.col("ts").cast("timestamp").alias("at"), (F.col("amount") * 100).cast("long").alias("cents"))
    rows = debits.select("user_id", dates.month_key(F.to_date(F.col("at"))).alias("month"), "category", "cents", F.unix_millis("at").alias("at_ms"))
    limits = budgets.select("user_id", "category", (F.col("budget") * 100).cast("long").alias("budget_cents")).hint("merge")  # looks small to the planner, which would send it through the driver
    delay_ms = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {late}"))).first()[0]
    sums, clock = Versions(spark, f"{base}/sums", _STATE), Versions(spark, f"{base}/clock", _CLOCK)
    too_late = {}

    def merge(batch: DataFrame, n: int) -> None:
        newest, mark_before = clock.read(n - 1).first() or (None, None)
        mark = None if newest is None else newest - delay_ms
        in_time = batch
        if mark is not None:
            is_late = F.coalesce(F.col("at_ms") <= mark, F.lit(False))
            too_late[n], in_time = batch.where(is_late).join(limits, ["user_id", "category"]).count(), batch.where(~is_late)
        new = in_time.groupBy(_KEYS).agg(F.sum("cents").alias("cents"), F.max("at_ms").alias("at_ms")).join(limits, ["user_id", "category"])
        old = sums.read(n - 1).drop("budget_cents", "alert")
        if mark_before is not None:
            old = old.where(F.coalesce(F.col("at_ms") + keep_ms > mark_before, F.lit(True)))
        both = new.withColumn("sent", F.lit(False)).unionByName(old, allowMissingColumns=True)
        summed = both.groupBy(_KEYS).agg(F.sum("cents").alias("cents"), *(F.max(c).alias(c) for c in ("budget_cents", "at_ms", "sent")))
        alert = ~F.col("sent") & F.coalesce(F.col("cents") > F.col("budget_cents"), F.lit(False))  # without rows of this batch there is no budget
        sent = sums.write(summed.withColumn("alert", alert).withColumn("sent", F.col("sent") | F.col("alert")), n).where("alert")
        sent.select(*_KEYS, (F.col("cents") / 100).alias("spent"), (F.col("budget_cents") / 100).alias("budget"), F.timestamp_millis("at_ms").alias("at")).write.mode("overwrite").parquet(f"{base}/out/batch={n}")
        latest = batch.agg(F.max("at_ms").alias("at_ms")).select(F.greatest("at_ms", F.lit(newest).cast("long")).alias("at_ms"), F.lit(mark).cast("long").alias("mark_ms"))
        clock.write(latest, n)

    run(rows, "append", base, _OUT, merge)
    return results(spark, base, _OUT).drop("batch", "at"), sum(too_late.values())
